"""Co-occurrence and evidence graphs (G1 - G9). A record's labels are exploded one by one, each
with what it pairs with; one aggregation follows. Communities run on the driver over the selected
subgraph of top_n nodes, as many as its caller asked for."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.functions.text import unroll
from bibspark.sources.shared import kept, shared_folder

#: Pairs of node types that the evidence graph connects.
PAIRS = (("author", "author"), ("author", "affiliation"), ("author", "journal"), ("author", "topic"), ("author", "year"), ("journal", "year"), ("topic", "year"), ("affiliation", "topic"))
#: Nodes are weighed in so many buckets; those of a bucket with OFTEN times the mean of pairs are paired before
#: the exchange, the others after it, some TASK_PAIRS in a task.
NODE_BUCKETS, OFTEN, TASK_PAIRS = 1 << 14, 8, 1 << 21
#: Stands between the labels of a text.
BETWEEN = "\x01"
#: Nodes that a task of components() remembers at a time.
FOREST_NODES = 1 << 20


def pairs(df: DataFrame, values: Column) -> DataFrame:
    """src, dst: all unordered pairs (src < dst) of an array's distinct values. A row holds one value
    and those behind it, never all pairs."""
    labels = df.select(F.array_sort(F.array_distinct(values)).alias("v")).where(F.size("v") > 1)
    firsts = labels.select("v", F.posexplode("v").alias("i", "src"))
    return firsts.select("src", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("dst"))


def collaboration_edges(works: DataFrame, values: str, max_party: int | None = None) -> DataFrame:
    """Src, dst, weight. max_party leaves out larger works (none by default)."""
    kept = works if max_party is None else works.where(F.size(values) <= max_party)
    return pairs(kept, F.col(values)).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def collaboration_nodes(works: DataFrame, values: str) -> DataFrame:
    return works.select(F.explode(F.array_distinct(values)).alias("node")).groupBy("node").agg(F.count("*").alias("publications"))


def chains(works: DataFrame, values: str) -> DataFrame:
    """src, dst: each label of a record with the next one. They connect what all its pairs connect."""
    labels = works.select(F.array_distinct(values).alias("v")).where(F.size("v") > 1)
    return labels.select(F.inline(F.arrays_zip(F.expr("slice(v, 1, size(v) - 1)").alias("src"), F.expr("slice(v, 2, size(v) - 1)").alias("dst"))))


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("node"), "weight").unionByName(edges.select(F.col("dst").alias("node"), "weight"))
    return both.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an edge, and their degrees."""
    return nodes.join(degrees(edges), "node")


def rank_nodes(nodes: DataFrame, k: int) -> DataFrame:
    """Publications, weighted degree, degree and label, all descending."""
    return nodes.orderBy(F.desc("publications"), F.desc("weighted_degree"), F.desc("degree"), F.desc(F.lower("node")), F.desc("node")).limit(k)


def induced(edges: DataFrame, nodes: DataFrame, column: str = "node") -> DataFrame:
    """Edges both of whose ends are among nodes."""
    ends = nodes.select(F.col(column).alias("end"))
    return edges.join(ends, edges["src"] == F.col("end"), "left_semi").join(ends, edges["dst"] == F.col("end"), "left_semi")


def top_induced(nodes: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k best nodes' subgraph without isolated nodes: nodes, edges. The edges are computed once
    and kept in the shared folder, as the ranking and the choice both read them."""
    edges = kept(edges)
    best = kept(rank_nodes(connected_nodes(nodes, edges), k))
    found = induced(edges, F.broadcast(best))
    return best.join(degrees(found).select("node"), "node", "left_semi"), found


def _forest(batches):
    """The edges that connect what was not connected before, in the order of a task's rows; its
    memory is emptied at FOREST_NODES nodes, which lets more edges through and loses none."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        keep = []
        for src, dst in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(src), root(dst)
            keep.append(a != b)
            up[a] = b
        yield batch.filter(pa.array(keep, pa.bool_()))
        if len(up) > FOREST_NODES:
            up.clear()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Node, component (the least label reachable), by least labels of neighbours with pointer
    jumping; each round is checkpointed to the shared folder of spark.checkpoint.dir. Each task first
    leaves out the edges between nodes that its other edges connect, so that the rounds run over no more
    than its nodes' number of edges, not over all pairs."""
    edges = edges.select("src", "dst").where("src is not null and dst is not null").mapInArrow(_forest, "src string, dst string")
    context = edges.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(edges.sparkSession))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().checkpoint()
    label = both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("component")).checkpoint()
    for _ in range(max_rounds):
        near = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        mine = label.join(near, "node").select("node", "component", F.least("component", "near").alias("new"))
        jump = mine.select(F.col("node").alias("new"), F.col("new").alias("far"))
        after = mine.join(jump, "new", "left").select("node", F.col("component").alias("was"), F.least("new", "far").alias("component")).checkpoint()
        if after.where("was <> component").isEmpty():
            return after.select("node", "component")
        label = after.select("node", "component")
    raise RuntimeError("components did not converge")


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Greedy modularity (Clauset, Newman and Moore 2004) on a selected subgraph: node,
    community, numbered by size descending, then least label. Of equal gains the pair of least
    labels merges first. The subgraph is that of a top list (G6) and comes to the driver."""
    names = sorted(r["node"] for r in nodes.select("node").collect())
    links = {(r["src"], r["dst"]): float(r["weight"]) for r in edges.collect()}
    groups = greedy_modularity(names, links)
    groups.sort(key=lambda g: (-len(g), min(g)))
    rows = [(n, k + 1) for k, g in enumerate(groups) for n in sorted(g)]
    return nodes.sparkSession.createDataFrame(rows, "node string, community int")


def greedy_modularity(names: list[str], links: dict[tuple[str, str], float]) -> list[set[str]]:
    total = sum(links.values())
    groups = {n: {n} for n in names}
    if not total:
        return list(groups.values())
    between: dict[str, dict[str, float]] = {n: {} for n in names}
    share = dict.fromkeys(names, 0.0)
    for (a, b), w in links.items():
        between[a][b] = between[b][a] = between[a].get(b, 0.0) + w
        share[a] += w / (2 * total)
        share[b] += w / (2 * total)
    while True:
        gains = [(w / total - 2 * share[a] * share[b], a, b) for a in groups for b, w in between[a].items() if a < b]
        best = max((g for g, _, _ in gains), default=0.0)
        if best <= 1e-12:
            return list(groups.values())
        _, a, b = min((x for x in gains if x[0] >= best - 1e-12), key=lambda x: x[1:])
        groups[a] |= groups.pop(b)
        share[a] += share.pop(b)
        for n, w in between.pop(b).items():
            between[n].pop(b)
            if n != a:
                between[a][n] = between[n][a] = between[a].get(n, 0.0) + w


def typed_nodes(fields: dict[str, Column], placed: bool = False) -> Column:
    """Array of (type, label) of a record; fields hold arrays of labels. placed: also kind and place,
    the numbers of the field and of the label in it."""
    def of(k: int, t: str, c: Column) -> Column:
        one = lambda x, i: F.struct(F.lit(t).alias("type"), x.alias("label"), *([F.lit(k).alias("kind"), i.alias("place")] if placed else []))
        return F.transform(F.array_distinct(c), one if placed else lambda x: one(x, None))

    return F.concat(*[of(k, t, c) for k, (t, c) in enumerate(fields.items())])


def node_id(kind: Column, label: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.lower(label))


def evidence_nodes(records: DataFrame, fields: dict[str, Column], title: str, citations: str, ordinal: str | None = None) -> DataFrame:
    """Id, type, label, occurrences, citations, papers (by title). ordinal: the column with the
    records' numbers; label is then the first spelling seen, and first_seen (ordinal, kind, place) tells
    where the node first stands. Without it label is the least spelling."""
    given = [F.col(title).alias("t"), F.col(citations).alias("c")] + ([F.col(ordinal).alias("o")] if ordinal else [])
    rows = unroll(records, *given, array=typed_nodes(fields, bool(ordinal)), key="type")
    # first by title, in numbers alone, which are added up before the exchange and without a sort
    at, first = (["kind", "place"], [F.min("o").alias("o")]) if ordinal else ([], [])
    rows = rows.groupBy("type", "label", *at, "t").agg(F.count("*").alias("n"), F.sum("c").alias("c"), *first)
    seen = F.struct("o", "kind", "place")
    label = [F.min_by("label", seen).alias("label"), F.min(seen).alias("first_seen")] if ordinal else [F.min("label").alias("label")]
    out = rows.groupBy(node_id(F.col("type"), F.col("label")).alias("id"), "type").agg(
        *label, F.sum("n").alias("occurrences"), F.sum("c").alias("citations"), F.count_distinct("t").alias("papers")
    )
    return out.withColumn("first_seen", F.struct(F.col("first_seen.o").alias("ordinal"), "first_seen.kind", "first_seen.place")) if ordinal else out


def top_nodes(nodes: DataFrame, k: int = 20) -> DataFrame:
    """Citations and occurrences descending, then first seen."""
    return nodes.orderBy(F.desc("citations"), F.desc("occurrences"), "first_seen").limit(k)


def evidence_edges(records: DataFrame, fields: dict[str, Column], title: str, citations: str, allowed=PAIRS, among: dict[str, Column] | None = None) -> DataFrame:
    """Src < dst, weight, weight_raw, citations, papers. Pairs of one type count twice in
    weight and citations, as both orders are visited (weight_raw: once). among: an array of ids
    for each type, which the ends of the edges are in; other labels are left out before they are paired.
    Without it the records' labels are kept in the shared folder, as they are read three times."""
    kinds, allowed = list(fields), [(b, a) if (b, a) in allowed[:i] else (a, b) for i, (a, b) in enumerate(allowed)]
    labels = {k: F.array_distinct(F.transform(fields[k], partial(node_id, F.lit(k)))) for k in kinds}
    if among is not None:
        labels = {k: F.array_intersect(v, among[k]) for k, v in labels.items()}
    # a title's 64 bits stand for it in the exchange
    own = records.select(F.when(F.col(title).isNotNull(), F.xxhash64(title)).alias("t"), F.col(citations).alias("c"), *[labels[k].alias(k) for k in kinds])
    if among is not None:
        found = _edges(_paired(_postings(own, kinds, allowed)))
    else:
        own = kept(own)
        often, parts = _dealt(own, kinds, allowed)
        # a node's records meet in one task, which pairs them there, so that no pairs are exchanged;
        # those of frequent nodes are paired and added up before an exchange
        found = _edges(_paired(_unpacked(_packed(_postings(own, kinds, allowed, lambda x: ~_bucket(x).isin(often))).repartition(parts, "x"))))
        if often:
            found = found.unionByName(_edges(_paired(_postings(own, kinds, allowed, lambda x: _bucket(x).isin(often)))))
    same = reduce(lambda one, k: one | (F.startswith("x", F.lit(f"{k}:")) & F.startswith("y", F.lit(f"{k}:"))), [a for a, b in allowed if a == b], F.lit(False))
    times = F.when(same, 2).otherwise(1)
    return found.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"), (F.col("n") * times).alias("weight"), F.col("n").alias("weight_raw"), (F.col("c") * times).alias("citations"), "papers")


def _bucket(x: str | Column) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(NODE_BUCKETS))


def _dealt(own: DataFrame, kinds: list[str], allowed) -> tuple[list[int], int]:
    """The buckets of nodes with OFTEN times the mean of pairs, and into how many tasks the pairs of the
    others go. A type's own pairs are taken as all labels with all."""
    def weighed(k: str) -> Column:
        n = reduce(Column.__add__, [F.size(b) for a, b in allowed if a == k]).cast("long")
        return F.transform(k, lambda x: F.struct(_bucket(x).alias("bucket"), n.alias("n")))

    rows = unroll(own, array=F.concat(*[weighed(k) for k in kinds if any(a == k for a, _ in allowed)]), key="bucket")
    pairs = {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    most = OFTEN * sum(pairs.values()) / NODE_BUCKETS
    often = sorted(k for k, n in pairs.items() if n > most)
    left = sum(n for n in pairs.values() if n <= most)
    return often, max(own.sparkSession.sparkContext.defaultParallelism, -(-left // TASK_PAIRS))


def _postings(own: DataFrame, kinds: list[str], allowed, wanted: Callable[[Column], Column] = F.isnotnull) -> DataFrame:
    """t, c, x, ys: a row for each wanted label of a record with those that it pairs with; of its own
    kind, the labels behind it."""
    def partners(k: str) -> Column:
        return F.concat(none, *[F.filter(F.col(b), lambda y: y > F.col("x")) if a == b else F.col(b) for a, b in allowed if a == k])

    def numbered(k: str) -> Column:
        return F.transform(F.filter(k, wanted), lambda x: F.struct(F.lit(kinds.index(k)).alias("kind"), x.alias("x")))

    none, first = F.array().cast("array<string>"), [k for k in kinds if any(a == k for a, _ in allowed)]
    rows = unroll(own, "t", "c", *kinds, array=F.concat(*map(numbered, first)), key="x")
    return rows.select("t", "c", "x", reduce(lambda rest, k: F.when(F.col("kind") == kinds.index(k), partners(k)).otherwise(rest), first, none).alias("ys"))


def _packed(postings: DataFrame) -> DataFrame:
    """ys as one text, half as long in an exchange; as they are where one of them holds the BETWEEN."""
    plain = F.forall("ys", lambda y: ~F.contains(F.coalesce(y, F.lit("")), F.lit(BETWEEN)))
    return postings.select("t", "c", "x", F.when(plain, F.array_join("ys", BETWEEN)).alias("text"), F.when(~plain, F.col("ys")).alias("ys"))


def _unpacked(packed: DataFrame) -> DataFrame:
    return packed.select("t", "c", "x", F.coalesce("ys", F.when(F.col("text") != "", F.split("text", BETWEEN))).alias("ys"))


def _paired(postings: DataFrame) -> DataFrame:
    return postings.select("t", "c", "x", F.explode_outer("ys").alias("y")).where("y is not null")


def _edges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.count_distinct("t").alias("papers"))


def top_typed(nodes: DataFrame, k: int, min_citations: float = 0) -> DataFrame:
    """By type, citations, occurrences, label descending; the limit of citations comes after the cut."""
    w = Window.partitionBy("type").orderBy(F.desc("citations"), F.desc("occurrences"), F.desc(F.lower("label")), F.desc("id"))
    return nodes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).where(F.col("citations") >= min_citations)


def top_typed_edges(records: DataFrame, fields: dict[str, Column], title: str, citations: str, k: int, min_citations: float = 0) -> DataFrame:
    """The evidence edges between the nodes of T2: k of each type at most, so that their ids are one
    row beside every record, and no other labels are paired."""
    kept = top_typed(evidence_nodes(records, fields, title, citations), k, min_citations)
    ids = kept.agg(*[F.collect_list(F.when(F.col("type") == t, F.col("id"))).alias(f"__{t}") for t in fields])
    return evidence_edges(records.crossJoin(F.broadcast(ids)), fields, title, citations, among={t: F.col(f"__{t}") for t in fields})


def six_type_edges(papers: DataFrame) -> DataFrame:
    """Papers (journal, authors, topic, year, paper, band) -> src, dst, type, weight. Ids are
    type:lower(label)."""
    i = lambda t, c: F.concat(F.lit(f"{t}:"), F.lower(c.cast("string")))
    p = {t: i(t, F.col(t)) for t in ("journal", "topic", "year", "paper")} | {"citation": i("citation", F.col("band"))}
    edge = lambda a, b, t: F.struct(a.alias("src"), b.alias("dst"), F.lit(t).alias("type"))
    authors = F.transform("authors", lambda a: i("author", a))
    every = F.concat(
        F.transform(authors, lambda a: edge(a, p["journal"], "author-journal")),
        F.transform(authors, lambda a: edge(a, p["topic"], "author-topic")),
        F.array(edge(p["topic"], p["year"], "topic-year"), edge(p["year"], p["paper"], "year-paper"), edge(p["paper"], p["topic"], "paper-topic"), edge(p["paper"], p["citation"], "paper-citation")),
    )
    return unroll(papers, array=every, key="type").groupBy("src", "dst", "type").agg(F.count("*").alias("weight"))


def six_type_nodes(papers: DataFrame, caps: dict[str, int]) -> DataFrame:
    """The most frequent labels of each type within its cap: id, type, label, n, rank."""
    f = {t: F.array(F.col(c).cast("string")) for t, c in (("journal", "journal"), ("topic", "topic"), ("year", "year"), ("paper", "paper"), ("citation", "band"))} | {"author": F.col("authors")}
    rows = unroll(papers, array=typed_nodes(f), key="type").groupBy("type", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("type").orderBy(F.desc("n"), F.lower("label"), "label")
    cap = F.element_at(F.create_map(*[x for t, k in caps.items() for x in (F.lit(t), F.lit(k))]), F.col("type"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap).withColumn("id", node_id(F.col("type"), F.col("label")))
