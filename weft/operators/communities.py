"""Shared-neighbour graphs and their communities, all batches at once.

Edges come from an inverted list of neighbours: cells that have a neighbour in common. A cell that very many have as a
neighbour is split, so that its pairs are made by several tasks. Communities are found by rounds of parallel moves: in a
round a hash lets half of the nodes move to the community that raises modularity most (links and community totals are
aggregates); a node alone moves to another one alone only towards the smaller name, so two don't swap. Then communities
become nodes, by an aggregate of edges. Once a batch has few enough edges, whatever its cells, a task ends it by local
moves in order.

Defined cases: cells without an edge are communities of their own; ties go to the own community, then to the smaller
name; communities are numbered from 1 by their least cell.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .kmeans import numbered

#: Holders of a neighbour in one part; edges of a batch that a task ends; rounds of a level, and the share of moved nodes that ends it.
HOLDERS, LOCAL, ROUNDS, STILL = 128, 200_000, 8, 0.005
LEAST = 1e-6


def shared_edges(near: DataFrame, k: int) -> DataFrame:
    """(batch, i, j, w), i < j: cells with a neighbour in common (a cell is its own, of rank 0), weighed by the best one: k less half the sum of its ranks."""
    held = near.select("batch", F.col("cell_id").alias("i"), F.posexplode("near").alias("r", "c")).withColumn("r", F.col("r") + 1)
    held = held.unionByName(near.select("batch", F.col("cell_id").alias("i"), F.lit(0).alias("r"), F.col("cell_id").alias("c")))
    parts = held.groupBy("batch", "c").agg(F.ceil(F.count("*") / HOLDERS).cast("int").alias("parts"))
    held = materialize(held.join(parts, ["batch", "c"]), "holders")
    one = held.select("batch", "c", "i", F.col("r").alias("ri"), F.pmod(F.xxhash64("i"), F.col("parts")).cast("int").alias("part"))
    two = held.select("batch", "c", F.col("i").alias("j"), F.col("r").alias("rj"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = one.join(two, ["batch", "c", "part"]).where("i < j")
    return both.groupBy("batch", "i", "j").agg(F.greatest(F.max(F.lit(float(k)) - (F.col("ri") + F.col("rj")) / 2), F.lit(LEAST)).alias("w"))


def louvain(n: int, weight: dict, loops: dict | None = None) -> list[int]:
    """Modularity communities by local moves and aggregation, in a fixed order; labels 1.. by first node. loops: weight inside a node."""
    node = list(range(n))
    graph: dict = defaultdict(lambda: defaultdict(float))
    for (i, j), w in weight.items():
        graph[i][j] += w
        graph[j][i] += w
    for i, w in (loops or {}).items():
        graph[i][i] += w
    total = sum(weight.values()) + sum((loops or {}).values()) or 1.0
    size = n
    while True:
        com = list(range(size))
        deg = [sum(graph[i].values()) + graph[i].get(i, 0.0) for i in range(size)]
        tot = deg[:]
        moved = any_move = True
        any_move = False
        while moved:
            moved = False
            for i in range(size):
                own = com[i]
                links: dict = defaultdict(float)
                for j, w in graph[i].items():
                    if j != i:
                        links[com[j]] += w
                tot[own] -= deg[i]
                best = max([own, *sorted(links)], key=lambda c: (round(links.get(c, 0.0) - tot[c] * deg[i] / (2 * total), 12), c == own))
                tot[best] += deg[i]
                if best != own:
                    com[i], moved, any_move = best, True, True
        names = {c: a for a, c in enumerate(dict.fromkeys(com))}
        node = [names[com[v]] for v in node]
        if not any_move:
            break
        new: dict = defaultdict(lambda: defaultdict(float))
        for i in range(size):
            for j, w in graph[i].items():
                a, b = names[com[i]], names[com[j]]
                new[a][b] += w if a != b or i == j else w / 2
        graph, size = new, len(names)
    first = {c: a for a, c in enumerate(dict.fromkeys(node), 1)}
    return [first[c] for c in node]


def modularity(edges: DataFrame, labels: DataFrame) -> dict:
    """{batch: modularity} of labels(batch, cell_id, cluster) on edges(batch, i, j, w)."""
    named = labels.select("batch", F.col("cell_id").alias("i"), F.col("cluster").alias("ci")), labels.select("batch", F.col("cell_id").alias("j"), F.col("cluster").alias("cj"))
    e = edges.join(named[0], ["batch", "i"]).join(named[1], ["batch", "j"])
    inside = e.groupBy("batch").agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ci") == F.col("cj"), F.col("w")).otherwise(0.0)).alias("in"))
    ends = e.select("batch", F.col("ci").alias("c"), "w").unionByName(e.select("batch", F.col("cj").alias("c"), "w"))
    square = ends.groupBy("batch", "c").agg(F.sum("w").alias("d")).groupBy("batch").agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return {r["batch"]: r["in"] / r["m"] - r["dd"] / (4 * r["m"] ** 2) for r in inside.join(square, "batch").collect()}


def _round(edges: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """labels(batch, node, com, deg) after the moves of one round. edges: both ways, without loops."""
    total = labels.groupBy("batch", "com").agg(F.sum("deg").alias("tot"), F.count("*").alias("size"))
    whole = labels.groupBy("batch").agg(F.sum("deg").alias("m2"))
    side = labels.select("batch", F.col("node").alias("j"), F.col("com").alias("to"))
    links = edges.join(side, ["batch", "j"]).groupBy("batch", "i", "to").agg(F.sum("w").alias("w"))
    links = links.select("batch", F.col("i").alias("node"), "to", "w").unionByName(labels.select("batch", "node", F.col("com").alias("to"), F.lit(0.0).alias("w")))
    links = links.groupBy("batch", "node", "to").agg(F.sum("w").alias("w"))
    own = total.select("batch", "com", F.col("size").alias("own_size"))
    all_ = links.join(labels.join(own, ["batch", "com"]), ["batch", "node"]).join(total.withColumnRenamed("com", "to"), ["batch", "to"]).join(whole, "batch")
    stays = F.col("to") == F.col("com")
    gain = F.round(F.col("w") - (F.col("tot") - F.when(stays, F.col("deg")).otherwise(0.0)) * F.col("deg") / F.greatest("m2", F.lit(1e-300)), 9)
    awake = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
    may = stays | (awake & ~((F.col("own_size") == 1) & (F.col("size") == 1) & (F.col("to") > F.col("com"))))
    best = all_.where(may).groupBy("batch", "node").agg(F.min(F.struct((-gain).alias("g"), (~stays).alias("s"), F.col("to").alias("to"))).alias("b"), F.first("com").alias("old"), F.first("deg").alias("deg"))
    return best.select("batch", "node", F.col("b.to").alias("com"), "deg", (F.col("b.to") != F.col("old")).alias("moved"))


def _level(edges: DataFrame, nodes: DataFrame, turn: int) -> tuple[DataFrame, int]:
    """Communities of nodes(batch, node, deg), each at first its own."""
    labels = materialize(nodes.select("batch", "node", F.col("node").alias("com"), "deg"), "labels")
    n = labels.count()
    quiet = 0
    for _ in range(ROUNDS):
        turn += 1
        new = materialize(_round(edges, labels, turn), "labels")
        moved = new.where("moved").count()
        labels = new.drop("moved")
        quiet = quiet + 1 if moved <= STILL * n else 0
        if quiet == 2:  # both halves rest
            break
    return labels, turn


def _ended(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(batch, node, com): a batch of few edges, ended in one task. edges(batch, i, j, w), i < j."""
    kind = dict(nodes.dtypes)

    def local(some: pa.Table, links: pa.Table) -> pa.Table:
        some = some.sort_by("node")
        names = some["node"].to_pylist()
        place = {v: i for i, v in enumerate(names)}
        weight = {(place[i], place[j]): w for i, j, w in zip(links["i"].to_pylist(), links["j"].to_pylist(), links["w"].to_pylist(), strict=True)}
        left = some["deg"].to_pylist()
        for (i, j), w in weight.items():
            left[i] -= w
            left[j] -= w
        label = louvain(len(names), weight, {i: max(w, 0.0) / 2 for i, w in enumerate(left)})
        least: dict = {}
        for v, c in zip(names, label, strict=True):
            least.setdefault(c, v)
        return pa.table({"batch": some["batch"], "node": some["node"], "com": pa.array([least[c] for c in label], some.schema.field("node").type)})

    return nodes.groupBy("batch").cogroup(edges.groupBy("batch")).applyInArrow(local, f"batch {kind['batch']}, node {kind['node']}, com {kind['node']}")


def communities(edges: DataFrame, cells: DataFrame, local: int = LOCAL) -> DataFrame:
    """(cell_id, batch, cluster) of cells(cell_id, batch), by modularity on edges(batch, i, j, w), i < j."""
    edges = materialize(edges.select("batch", "i", "j", "w"), "edges")
    ends = edges.select("batch", F.col("i").alias("node"), "w").unionByName(edges.select("batch", F.col("j").alias("node"), "w"))
    degree = ends.groupBy("batch", "node").agg(F.sum("w").alias("deg"))
    names = cells.select("batch", F.col("cell_id").alias("node"))
    nodes = materialize(names.join(degree, ["batch", "node"], "left").fillna(0.0, ["deg"]), "nodes")
    member = nodes.select("batch", F.col("node").alias("cell_id"), F.col("node").alias("com"))
    turn = 0
    while True:
        turned = edges.unionByName(edges.select("batch", F.col("j").alias("i"), F.col("i").alias("j"), "w"))
        labels, turn = _level(turned, nodes, turn)
        before = nodes.count()
        nodes = materialize(labels.groupBy("batch", F.col("com").alias("node")).agg(F.sum("deg").alias("deg")), "nodes")
        step = labels.select("batch", F.col("node").alias("com"), F.col("com").alias("up"))
        member = materialize(member.join(step, ["batch", "com"]).select("batch", "cell_id", F.col("up").alias("com")), "members")
        a, b = labels.select("batch", F.col("node").alias("i"), F.col("com").alias("ci")), labels.select("batch", F.col("node").alias("j"), F.col("com").alias("cj"))
        up = edges.join(a, ["batch", "i"]).join(b, ["batch", "j"]).where("ci <> cj")
        edges = materialize(up.groupBy("batch", F.least("ci", "cj").alias("i"), F.greatest("ci", "cj").alias("j")).agg(F.sum("w").alias("w")), "edges")
        most = edges.groupBy("batch").count().agg(F.max("count")).first()[0] or 0
        if most <= local or nodes.count() == before:
            break
    if most <= local:
        step = _ended(edges, nodes).select("batch", F.col("node").alias("com"), F.col("com").alias("up"))
        member = member.join(step, ["batch", "com"]).select("batch", "cell_id", F.col("up").alias("com"))
    return numbered(materialize(member, "members"), "com")


