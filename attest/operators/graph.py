"""The graph of approved facts: many corpora at once, iterations as joins.

Loops keep nothing in one place: a step's result is written to the folder in spark.checkpoint.dir, so
lineage stays short and a lost executor repeats one step only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.text import round_places
from attest.operators._store import saved
from attest.operators.ranks import numbered

#: Rounds of PageRank between two written tables.
WRITTEN = 5


def _cut(df: DataFrame) -> DataFrame:
    return saved(df, "graph")


def graph_edges(triples: DataFrame) -> DataFrame:
    """Distinct (corpus, subject, predicate, object) without loops."""
    return triples.filter("subject_id <> object_id").select("corpus_id", "subject_id", "predicate", "object_id").distinct()


def graph_nodes(triples: DataFrame) -> DataFrame:
    """Every end of a triple, those of loops too."""
    return triples.select("corpus_id", F.explode(F.array("subject_id", "object_id")).alias("node_id")).distinct()


def graph_degree(triples: DataFrame) -> DataFrame:
    """Per node: distinct neighbours out and in, predicates used, triples as subject."""
    e = graph_edges(triples)
    out = e.groupBy("corpus_id", F.col("subject_id").alias("node_id")).agg(F.countDistinct("object_id").alias("out_degree"), F.countDistinct("predicate").alias("n_predicates"), F.count("*").alias("n_triples"))
    into = e.groupBy("corpus_id", F.col("object_id").alias("node_id")).agg(F.countDistinct("subject_id").alias("in_degree"))
    rows = graph_nodes(triples).join(out, ["corpus_id", "node_id"], "left").join(into, ["corpus_id", "node_id"], "left")
    return rows.fillna(0, ["out_degree", "n_predicates", "n_triples", "in_degree"])


def graph_links(triples: DataFrame) -> DataFrame:
    """Distinct (corpus_id, subject_id, object_id), with loops, so that every node is an end of one."""
    return triples.select("corpus_id", "subject_id", "object_id").distinct()


def graph_ends(links: DataFrame) -> DataFrame:
    """Per node of distinct links, in one sum: neighbours out and in, the least and the greatest neighbour; loops count nothing."""
    other = lambda a, b: F.when(F.col(a) != F.col(b), F.col(b)).alias("other")
    end = lambda a, b, out: F.struct(F.col(a).alias("node_id"), other(a, b), F.lit(out).alias("out"))
    ends = links.select("corpus_id", F.inline(F.array(end("subject_id", "object_id", True), end("object_id", "subject_id", False))))
    n = lambda out: F.count_if(out & F.col("other").isNotNull())
    return ends.groupBy("corpus_id", "node_id").agg(n(F.col("out")).alias("out_degree"), n(~F.col("out")).alias("in_degree"), F.min("other").alias("least"), F.max("other").alias("most"))


def graph_stats(triples: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Measures of each corpus; groups: communities (corpus_id, node_id, community), to be counted too."""
    d = graph_degree(triples).groupBy("corpus_id").agg(F.count("*").alias("n_nodes"), F.max("out_degree").alias("max_out"), F.max("in_degree").alias("max_in"))
    e = graph_edges(triples).groupBy("corpus_id").agg(F.count("*").alias("n_edges"))
    out = d.join(e, "corpus_id", "left").fillna(0, ["n_edges"])
    density = F.when(F.col("n_nodes") < 2, 0.0).otherwise(F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)))
    out = out.withColumn("density", F.round(density, 9))
    if groups is None:
        return out
    return out.join(groups.groupBy("corpus_id").agg(F.countDistinct("community").alias("n_communities")), "corpus_id", "left").fillna(0, ["n_communities"])


def _ranks_of_layers(nodes: DataFrame, links: DataFrame, damping: float, iterations: int) -> DataFrame:
    """Scores after so many rounds where no node that is linked to links on: one pass over links, rounds are arithmetic of a corpus.

    Nodes that nothing links to have the same score in a round, the base, so what they give a node is the base times the
    sum of 1 / out over those that link to it; of the others only the sum of their scores takes part, as what is lost.
    """
    keys = ["corpus_id", "node_id"]
    weight = links.join(nodes.filter("out is not null").select(*keys, "out").hint("shuffle_hash"), keys).groupBy("corpus_id", F.col("object_id").alias("node_id")).agg(F.sum(1.0 / F.col("out")).alias("weight"))
    nodes = _cut(nodes.join(weight, keys, "left").fillna(0.0, ["weight"]))
    end, n = F.col("out").isNull(), F.col("n")
    corpora = nodes.groupBy("corpus_id", "n").agg(F.count_if(end).alias("ends"), F.sum(F.when(end, F.col("weight")).otherwise(0.0)).alias("ends_weight"))

    def after(s: Column, _: Column) -> Column:
        base = (1 - damping) / n + damping * s["lost"] / n
        lost = F.col("ends") * base + damping * s["base"] * F.col("ends_weight")
        return F.struct(base.alias("base"), lost.alias("lost"), s["base"].alias("before"))

    start = F.struct((1.0 / n).alias("base"), (F.col("ends") / n).alias("lost"), F.lit(0.0).alias("before"))
    corpora = corpora.select("corpus_id", F.aggregate(F.array_repeat(F.lit(0), iterations), start, after).alias("s"))
    return _cut(nodes.join(corpora, "corpus_id").select(*keys, (F.col("s.base") + damping * F.col("s.before") * F.col("weight")).alias("score")))


def _ranks_by_rounds(nodes: DataFrame, links: DataFrame, damping: float, iterations: int) -> DataFrame:
    """Scores by one join of ranks to links on the node and one sum by node a round.

    Every node gives itself 0, so that none is lost, and what nodes without successors hold is one number per corpus. Ranks
    of a round are kept while the next ones need them and written every few rounds: lineage ends there, and a lost executor
    repeats those few rounds.
    """
    out = nodes.filter("out is not null").select("corpus_id", "node_id", "out")
    rank = nodes.withColumn("score", 1.0 / F.col("n"))
    # Links of a node in rows of about a thousand: few rows to join, and no row grows with a hub. They are dealt by node
    # once and kept so, and only what they pass on is dealt in a round.
    most = F.floor(F.pmod(F.xxhash64("object_id"), F.ceil(F.col("out") / 1000)))
    links = _cut(links.join(out, ["corpus_id", "node_id"]).groupBy("corpus_id", "node_id", most.alias("part")).agg(F.collect_list("object_id").alias("to")).drop("part"))
    links = links.repartition(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), "corpus_id", "node_id").persist()
    kept = []
    for k in range(iterations):
        lost = rank.groupBy("corpus_id").agg(F.sum(F.when(F.col("out").isNull(), F.col("score")).otherwise(0.0)).alias("lost"))
        given = rank.join(links, ["corpus_id", "node_id"], "left")
        to = F.concat(F.array(F.struct(F.col("node_id").alias("node_id"), F.lit(0.0).alias("part"), F.col("n").alias("n"), F.col("out").alias("out"))), F.transform(F.coalesce("to", F.array().cast("array<bigint>")), lambda x: F.struct(x.alias("node_id"), (F.col("score") / F.col("out")).alias("part"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("out"))))
        summed = given.select("corpus_id", F.explode(to).alias("x")).groupBy("corpus_id", "x.node_id").agg(F.sum("x.part").alias("given"), F.max("x.n").alias("n"), F.max("x.out").alias("out"))
        score = (1 - damping) / F.col("n") + damping * (F.col("given") + F.col("lost") / F.col("n"))
        rank = summed.join(lost, "corpus_id").select("corpus_id", "node_id", "n", "out", score.alias("score"))
        if k % WRITTEN == WRITTEN - 1 or k == iterations - 1:
            rank = _cut(rank)
            while kept:
                kept.pop().unpersist()
        else:
            rank = rank.persist()
            kept.append(rank)
    links.unpersist()
    return rank


def pagerank(triples: DataFrame, damping: float = 0.85, iterations: int = 50, links: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(corpus_id, node_id, score, rank) by so many rounds; what nodes without successors hold is shared by all.

    Rounds go over all links, unless no node that is linked to links on (suppliers and customers): then nothing that a round
    passes on depends on a node. links and ends: what ``graph_links`` and ``graph_ends`` gave, if they are there already.
    """
    links = _cut(graph_links(triples)) if links is None else links
    ends = _cut(graph_ends(links)) if ends is None else ends
    nodes = ends.join(ends.groupBy("corpus_id").agg(F.count("*").alias("n")), "corpus_id").select("corpus_id", "node_id", "n", F.nullif("out_degree", F.lit(0)).alias("out"))
    links = links.filter("subject_id <> object_id").select("corpus_id", F.col("subject_id").alias("node_id"), "object_id")
    layers = ends.filter("out_degree > 0 and in_degree > 0").isEmpty()
    rank = (_ranks_of_layers if layers else _ranks_by_rounds)(nodes, links, damping, iterations)
    total = rank.groupBy("corpus_id").agg(F.sum("score").alias("total"))
    scored = rank.join(total, "corpus_id").select("corpus_id", "node_id", round_places(F.col("score") / F.col("total"), 9).alias("score"))
    return numbered(scored, ["corpus_id"], [F.desc("score"), "node_id"], "rank")


def pagerank_topn(triples: DataFrame, names: DataFrame | None = None, n: int = 50, ranks: DataFrame | None = None, **how) -> DataFrame:
    """The n best nodes with their degrees, and names where given. ranks: what ``pagerank`` gave, if it is there already."""
    top = (pagerank(triples, **how) if ranks is None else ranks).filter(F.col("rank") <= n)
    out = top.join(graph_degree(triples).select("corpus_id", "node_id", "in_degree", "out_degree"), ["corpus_id", "node_id"])
    return out if names is None else out.join(names, ["corpus_id", "node_id"], "left")


def _both_ways(triples: DataFrame) -> DataFrame:
    """Each distinct link from either end. Links are dealt out before they are compared, so no task holds a table of all that a file has."""
    ends = F.array(F.struct(F.col("subject_id").alias("node_id"), F.col("object_id").alias("other")), F.struct(F.col("object_id").alias("node_id"), F.col("subject_id").alias("other")))
    links = triples.filter("subject_id <> object_id").select("corpus_id", F.inline(ends))
    return links.repartition("corpus_id", "node_id", "other").distinct()


def _roots(parent: DataFrame, most: int) -> DataFrame:
    """(corpus_id, node_id, parent) with lesser parents -> with the last of them; steps double."""
    for _ in range(most):
        above = parent.select("corpus_id", F.col("node_id").alias("parent"), F.col("parent").alias("further"))
        found = _cut(parent.join(above, ["corpus_id", "parent"]).select("corpus_id", "node_id", F.col("further").alias("parent"), (F.col("further") != F.col("parent")).alias("moved")))
        parent = found.drop("moved")
        if found.filter("moved").isEmpty():
            return parent
    raise RuntimeError(f"a chain of more than 2^{most} nodes")


def connected_components(triples: DataFrame, most: int = 200) -> DataFrame:
    """(corpus_id, node_id, component): the least node that is reachable.

    In a round every node joins its least neighbour, if that is lesser, and links between what is joined are dropped. So
    all links are read in the first round only; the next ones have a link for each pair of joined nodes.
    """
    keys = ["corpus_id", "node_id"]
    label = graph_nodes(triples).withColumn("component", F.col("node_id"))
    links = triples.filter("subject_id <> object_id").select("corpus_id", F.col("subject_id").alias("a"), F.col("object_id").alias("b"))
    for _ in range(most):
        ends = F.array(F.struct(F.col("a").alias("node_id"), F.least("a", "b").alias("parent")), F.struct(F.col("b").alias("node_id"), F.least("a", "b").alias("parent")))
        root = _roots(_cut(links.select("corpus_id", F.inline(ends)).groupBy(*keys).agg(F.min("parent").alias("parent"))), 64)
        to = lambda c: root.select("corpus_id", F.col("node_id").alias(c), F.col("parent").alias(f"{c}_root"))  # noqa: E731, B023
        label = _cut(label.join(to("component"), ["corpus_id", "component"], "left").select(*keys, F.coalesce("component_root", "component").alias("component")))
        joined = links.join(to("a"), ["corpus_id", "a"]).join(to("b"), ["corpus_id", "b"]).filter("a_root <> b_root")
        links = _cut(joined.select("corpus_id", F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
        if links.isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {most} rounds")


def _renumbered(labels: DataFrame) -> DataFrame:
    """Communities numbered from 0 by their least member."""
    least = labels.groupBy("corpus_id", "label").agg(F.min("node_id").alias("first"))
    number = numbered(least, ["corpus_id"], ["first"], "community").withColumn("community", F.col("community") - 1)
    return labels.join(number.select("corpus_id", "label", "community"), ["corpus_id", "label"]).select("corpus_id", "node_id", "community")


def wave_levels(links: DataFrame, nodes: DataFrame, most: int = 10_000) -> tuple[DataFrame, int]:
    """(corpus_id, node_id, level) and how many levels: a node is one above the highest of its neighbours of lesser id, 0 without any.

    Levels grow by a round each; nodes that have their final level by then are not looked at again.
    """
    lesser = _cut(links.filter("other < node_id"))
    level = _cut(nodes.withColumn("level", F.lit(0)))
    front = level.select("corpus_id", F.col("node_id").alias("other"))
    for k in range(1, most):
        # All that have a neighbour on the level before are on this one at least.
        front = _cut(lesser.join(front, ["corpus_id", "other"]).select("corpus_id", "node_id").distinct())
        if front.isEmpty():
            return level, k
        level = _cut(level.join(front.withColumn("here", F.lit(k)), ["corpus_id", "node_id"], "left").select("corpus_id", "node_id", F.coalesce("here", "level").alias("level")))
        front = front.select("corpus_id", F.col("node_id").alias("other"))
    raise RuntimeError(f"an increasing path of more than {most} nodes")


def _voted(label: DataFrame, votes: DataFrame) -> DataFrame:
    """Labels after votes (corpus_id, node_id, label, n): the greatest count, ties to the least label; and which moved."""
    keys = ["corpus_id", "node_id"]
    # Sums of plain numbers, which take no sort: the least label of each count, then that of the greatest.
    best = votes.repartition(*keys).groupBy(*keys, "n").agg(F.min("label").alias("label")).groupBy(*keys).agg(F.max_by("label", "n").alias("voted"))
    return _cut(label.join(best, keys, "left").select(*keys, F.coalesce("voted", "label").alias("label"), F.coalesce(F.col("voted") != F.col("label"), F.lit(False)).alias("moved")))


def _labels_of_layers(links: DataFrame, ends: DataFrame, sweeps: int) -> DataFrame:
    """Labels where a node's neighbours are all greater (the first layer) or all lesser (the second): a sweep has two steps.

    In the first step labels are all different, so that a node of the first layer takes the least. A step depends on the
    other layer only, so the first one that moves no label is the last. A link is there once and is read from either end.
    """
    keys = ["corpus_id", "node_id"]
    label = _cut(ends.select(*keys, F.when(F.col("least") > F.col("node_id"), F.col("least")).otherwise(F.col("node_id")).alias("label")))
    links = links.select("corpus_id", F.least("subject_id", "object_id").alias("first"), F.greatest("subject_id", "object_id").alias("second")).filter("first <> second")
    for k in range(1, 2 * sweeps):
        sender, receiver = ("first", "second") if k % 2 else ("second", "first")
        given = label.select("corpus_id", F.col("node_id").alias(sender), "label").hint("shuffle_hash").join(links, ["corpus_id", sender]).select("corpus_id", F.col(receiver).alias("node_id"), "label")
        # At first a node is given few labels twice, so there is nothing to sum before they are dealt to it.
        given = given.repartition(*keys) if k == 1 else given
        found = _voted(label, given.groupBy(*keys, "label").agg(F.count("*").alias("n")))
        label = found.drop("moved")
        if found.filter("moved").isEmpty():
            break
    return label


def wave_labels(triples: DataFrame, sweeps: int = 8, links: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(corpus_id, node_id, label) of label propagation node by node in ascending order.

    In a sweep a node sees the new labels of lesser neighbours and the old ones of greater, so nodes whose lesser
    neighbours are all done can go together: a sweep is a wave over levels, each a join of links with labels, a count by
    node and label (summed before it is shuffled) and the greatest count, ties to the least label. No task holds a
    component, or more of a node than its labels. Where there are two levels by order and no link has its reverse (suppliers
    and customers), levels need not be found. links and ends: what ``graph_links`` and ``graph_ends`` gave, if at hand.
    """
    keys = ["corpus_id", "node_id"]
    if sweeps > 0:
        links = _cut(graph_links(triples)) if links is None else links
        ends = _cut(graph_ends(links)) if ends is None else ends
        if ends.filter("(least < node_id and most > node_id) or (out_degree > 0 and in_degree > 0)").isEmpty():
            return _labels_of_layers(links, ends, sweeps)
    links = _cut(_both_ways(triples))
    nodes = _cut(graph_nodes(triples))
    level, n = wave_levels(links, nodes)
    links = _cut(links.join(level, keys))
    label = _cut(level.select(*keys, F.col("node_id").alias("label")))
    for _ in range(sweeps):
        before = label
        for k in range(n):
            own = links.filter(F.col("level") == k)
            votes = own.join(label.select("corpus_id", F.col("node_id").alias("other"), "label"), ["corpus_id", "other"]).groupBy(*keys, "label").agg(F.count("*").alias("n"))
            label = _voted(label, votes).drop("moved")
        if label.join(before.withColumnRenamed("label", "was"), keys).filter("label <> was").isEmpty():
            break
    return label


def communities(triples: DataFrame, sweeps: int = 8, links: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Communities by label propagation node by node in order, exactly, numbered from 0 by their least member."""
    return _renumbered(wave_labels(triples, sweeps, links, ends))


def sync_labels(triples: DataFrame, sweeps: int = 8, links: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Labels after so many rounds; where a round changes none, the next ones don't either.

    In the first round labels are all different, so that a node takes that of its least neighbour. Links are read from
    either end, and are made distinct both ways only if some node is linked both to and from. links and ends: what
    ``graph_links`` and ``graph_ends`` gave, if they are there already.
    """
    keys = ["corpus_id", "node_id"]
    links = _cut(graph_links(triples)) if links is None else links
    ends = _cut(graph_ends(links)) if ends is None else ends
    label = ends.select(*keys, (F.coalesce("least", "node_id") if sweeps > 0 else F.col("node_id")).alias("label"))
    if sweeps > 1:
        label = _cut(label)
        layers = ends.filter("out_degree > 0 and in_degree > 0").isEmpty()
        way = lambda a, b: F.struct(F.col(a).alias("node_id"), F.col(b).alias("other"))
        both = links.filter("subject_id <> object_id").select("corpus_id", F.inline(F.array(way("subject_id", "object_id"), way("object_id", "subject_id"))))
        links = both if layers else _cut(both.repartition("corpus_id", "node_id", "other").distinct())
    for k in range(1, sweeps):
        given = label.select("corpus_id", F.col("node_id").alias("other"), "label").hint("shuffle_hash").join(links, ["corpus_id", "other"]).select(*keys, "label")
        given = given.repartition(*keys) if k == 1 else given
        found = _voted(label, given.groupBy(*keys, "label").agg(F.count("*").alias("n")))
        label = found.drop("moved")
        if found.filter("moved").isEmpty():
            break
    return label


def communities_sync(triples: DataFrame, sweeps: int = 8, links: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Label propagation in rounds, all nodes at once; ties go to the least label. Labels differ from the exact ones."""
    return _renumbered(sync_labels(triples, sweeps, links, ends))


def community_members(members: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """A row for each member of each community, in order of id, with its name where names are given; a community of any size."""
    rows = members if names is None else members.join(names, ["corpus_id", "node_id"], "left")
    return numbered(rows, ["corpus_id", "community"], ["node_id"], "place")


def community_nested(members: DataFrame, names: DataFrame) -> DataFrame:
    """Communities with their sorted members and names in arrays: for those that are to be shown whole."""
    rows = members.join(names, ["corpus_id", "node_id"], "left")
    pairs = F.array_sort(F.collect_list(F.struct("node_id", "name")))
    return rows.groupBy("corpus_id", "community").agg(F.count("*").alias("size"), pairs.alias("m")).select("corpus_id", "community", "size", F.col("m.node_id").alias("members"), F.col("m.name").alias("names"))


def community_rows(members: DataFrame, names: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """Communities with size, first and last member and all members in order, with their names where names are given.

    Members come in pieces of so many, numbered from 0, a row each: a community of any size is there whole, and no row or
    group holds a large one.
    """
    keys = ["corpus_id", "community"]
    whole = members.groupBy(*keys).agg(F.count("*").alias("size"), F.min("node_id").alias("first_member"), F.max("node_id").alias("last_member"))
    own = ["place", "node_id", *([] if names is None else ["name"])]
    rows = community_members(members, names).withColumn("piece", F.floor((F.col("place") - 1) / most))
    rows = rows.groupBy(*keys, "piece").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("m"))
    rows = rows.select(*keys, "piece", F.col("m.node_id").alias("members"), *([] if names is None else [F.col("m.name").alias("names")]))
    return whole.join(rows, keys)


def graph_view(triples: DataFrame, names: DataFrame | None = None, verified: DataFrame | None = None, ranks: DataFrame | None = None, groups: DataFrame | None = None, only: str | None = None, links: DataFrame | None = None, ends: DataFrame | None = None, **how):
    """Nodes with degrees, score and community, edges with a label, and a row of measures per corpus; only: one of "nodes", "edges", "stats".

    triples: approved ones; with verified (triple_id) only those among them, as the scope VERIFIED_ONLY. ranks, groups,
    links and ends: what ``pagerank``, ``communities``, ``graph_links`` and ``graph_ends`` gave for these triples, if at hand.
    """
    if verified is not None:
        triples = triples.join(verified.select("triple_id").distinct(), "triple_id", "left_semi")
    keys = ["corpus_id", "node_id"]

    def edges() -> DataFrame:
        text = ["subject_text", "object_text"] if "subject_text" in triples.columns else []
        out = triples.select("corpus_id", "subject_id", "object_id", "predicate", *text)
        return out.withColumn("label", F.concat_ws(" ", "subject_text", "predicate", "object_text")).drop(*text) if text else out.distinct()

    if only == "edges":
        return edges()
    links = _cut(graph_links(triples)) if links is None else links
    ends = _cut(graph_ends(links)) if ends is None else ends
    groups = _cut(communities(triples, links=links, ends=ends)) if groups is None else groups
    stats = graph_stats(triples, groups)
    if only == "stats":
        return stats
    nodes = ends.select(*keys, "in_degree", "out_degree").join((pagerank(triples, links=links, ends=ends, **how) if ranks is None else ranks).select(*keys, "score"), keys).join(groups, keys)
    nodes = nodes if names is None else nodes.join(names, keys, "left")
    return nodes if only == "nodes" else (nodes, edges(), stats)


def verified_scope(triples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Triples whose subject key and predicate have a claim that is supported, and not overruled by people."""
    from attest.functions.text import entity_key

    good = verdicts.filter("verdict = 'SUPPORTED' and not (state = 'HUMAN_DECISION' and coalesce(human_verdict, '') <> 'SUPPORTED') and predicate is not null")
    keys = good.select("corpus_id", entity_key(F.col("subject")).alias("sk"), F.lower("predicate").alias("pk")).distinct()
    rows = triples.withColumns({"sk": entity_key(F.col("subject_text")), "pk": F.lower("predicate")})
    return rows.join(keys, ["corpus_id", "sk", "pk"], "left_semi").drop("sk", "pk")
