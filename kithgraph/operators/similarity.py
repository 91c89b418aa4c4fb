"""Similarities between nodes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithgraph.operators import matrix, packed
from kithgraph.operators.ordering import best
from kithgraph.operators.skew import in_blocks, lookup_join
from kithgraph.session import cut, tasks

#: A neighbour is hot if it has more than one part in so many of all edges; fewer than so many are, and each is a bit of a whole number.
HOT_BITS = 60


#: Nodes of one neighbour that meet each other in one group, and pairs that one task forms.
PAIR_ROWS, TASK_PAIRS = 2_000, 4_000_000


def met(own: DataFrame) -> DataFrame:
    """Pairs of nodes that share a neighbour, once for each that they share: ``a`` < ``b`` with their sizes ``na``, ``nb``. ``own`` (src, dst, size) should be cut, it is read several times.

    The nodes of a neighbour are dealt to blocks of about PAIR_ROWS, and every two blocks meet in a group of their own, so no group holds more than the square of that, however hot
    the neighbour; groups are spread over as many tasks as the number of pairs asks for.
    """
    counts = cut(own.groupBy("dst").agg(F.count(F.lit(1)).alias("__n")))
    total = counts.agg(F.sum(F.col("__n") * F.col("__n") / 2)).first()[0] or 0
    parts = counts.where(F.col("__n") > PAIR_ROWS).select("dst", F.ceil(F.col("__n") / PAIR_ROWS).cast("int").alias("__parts"))
    number = F.coalesce("__parts", F.lit(1))
    dealt = (own.withColumn("__parts", F.lit(1)) if parts.isEmpty() else lookup_join(own, parts, "dst", "left")).withColumn("__own", F.pmod(F.xxhash64("src"), number).cast("int"))
    width = max(own.sparkSession.sparkContext.defaultParallelism, tasks(own.sparkSession, int(total), TASK_PAIRS))
    one = dealt.select("dst", F.col("__own").alias("__i"), F.explode(F.sequence("__own", number - 1)).alias("__j"), F.col("src").alias("__a"), F.col("size").alias("__na"))
    two = dealt.select("dst", F.explode(F.sequence(F.lit(0), "__own")).alias("__i"), F.col("__own").alias("__j"), F.col("src").alias("__b"), F.col("size").alias("__nb"))
    group = ["dst", "__i", "__j"]
    both = one.repartition(width, *group).join(two.repartition(width, *group), group).where((F.col("__i") < F.col("__j")) & (F.col("__a") != F.col("__b")) | (F.col("__a") < F.col("__b")))
    first = F.col("__a") < F.col("__b")
    return both.select(
        F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"), F.when(first, F.col("__na")).otherwise(F.col("__nb")).alias("na"), F.when(first, F.col("__nb")).otherwise(F.col("__na")).alias("nb")
    )


def set_classes(edges: DataFrame) -> DataFrame:
    """``src``, ``class_id`` (the least src with the very same set of dst), ``size`` of the set and ``members`` of the class.

    Sets are told apart by their size and 192 bits of hashes of their elements that combine on the map side, so the list of a
    node with very many neighbours is never put together; a class of very many nodes is joined by broadcast.
    """
    parts = [F.bit_xor(F.xxhash64("dst")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "dst")).alias("h2"), F.bit_xor(F.xxhash64("dst", F.lit(2))).alias("h3")]
    signs = edges.groupBy("src").agg(F.count(F.lit(1)).alias("size"), *parts)
    signs = cut(signs.select("src", "size", F.struct("size", "h1", "h2", "h3").alias("sign")))
    classes = signs.groupBy("sign").agg(F.min("src").alias("class_id"), F.count(F.lit(1)).alias("members"))
    return lookup_join(signs, classes, "sign").select("src", "class_id", "size", "members")


def jaccard(edges: DataFrame, classes: DataFrame, digits: int | None = None) -> DataFrame:
    """Jaccard similarity of every two classes that share a neighbour: ``a`` < ``b`` (class ids), ``sim``.

    Nodes with the same neighbours have similarity 1 and are one class, so copies aren't expanded into pairs; together with
    ``set_classes`` this states all pairs of nodes. Weights of edges don't count; pairs without a shared neighbour are 0 and absent. ``digits``: to which they are rounded.
    Where the classes' edges are few enough to be sent to every task, each task makes the pairs of its classes and none is moved.
    """
    heads = classes.where(F.col("src") == F.col("class_id")).select("src", "size")
    own = cut(edges.select("src", "dst").join(heads, "src"))
    if packed.whole_numbers(edges, "src", "dst") and packed.few(own):
        return _jaccard_packed(own, digits)
    both = met(own).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    sim = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return both.select("a", "b", (sim if digits is None else F.round(sim, digits)).alias("sim"))


def _jaccard_packed(own: DataFrame, digits: int | None) -> DataFrame:
    src, dst = packed.gathered(own, "src", "dst")
    (ids, (src,)), (others, (dst,)) = packed.coded(src), packed.coded(dst)
    has = packed.Sparse(src, dst, None, (len(ids), len(others)))
    sent = own.sparkSession.sparkContext.broadcast((ids, has, has.transposed()))

    def of(asked: np.ndarray) -> Iterator[tuple]:
        ids, has, by = sent.value
        for a, k in zip(asked, packed.number(ids, asked)):
            mine = has.row(k)
            shared = by.counts(mine)[k + 1 :]
            at = np.flatnonzero(shared)
            both, at = shared[at], at + k + 1
            sim = both / (len(mine) + has.ptr[at + 1] - has.ptr[at] - both)
            yield np.full(len(at), a), ids[at], sim if digits is None else packed.rounded(sim, digits) / 10.0**digits

    return packed.each(own, "src", of, "a bigint, b bigint, sim double", 256)


def measure(pairs: DataFrame, classes: DataFrame, node: int) -> DataFrame:
    """The similarities of one node to all others that aren't 0, itself (1) included: ``b``, ``sim``."""
    own = classes.where(F.col("src") == node).select(F.col("class_id").alias("own"))
    both = pairs.unionAll(pairs.select("b", "a", "sim")).unionAll(classes.select("class_id", "class_id", F.lit(1.0)).distinct())
    near = both.join(F.broadcast(own), F.col("a") == F.col("own")).select(F.col("b").alias("class_id"), "sim")
    return near.join(classes, "class_id").select(F.col("src").alias("b"), "sim")


def nearest(pairs: DataFrame, classes: DataFrame, k: int | None) -> DataFrame:
    """For each node its ``k`` most similar others (None: all): ``a``, ``b``, ``sim``, ``rank``; ties by the lesser id.

    Of each class the k+1 nearest classes can hold the k nearest others of its members, and of each of those the k+1 least ids, so only these are expanded.
    """
    return _expanded(pairs.unionAll(pairs.select("b", "a", "sim")), classes, k)


def neighbours(edges: DataFrame, k: int | None) -> DataFrame:
    """As ``nearest``, from the edges, without forming the pairs that only hot neighbours make.

    Two nodes that share nothing but hot neighbours (such as the one repository that a third of all users have) have a similarity that follows
    from their sets of hot neighbours and their sizes. So nodes are grouped by these two; of each group the k+1 groups that are nearest, and
    of each the k+1 least ids, can hold the nearest nodes. Pairs that share another neighbour are formed over those only, and the hot ones
    they share are counted by bits. A pair found both ways keeps the greater, which is right. With ``k`` None all pairs are wanted, and formed.
    """
    classes = cut(set_classes(edges))
    if k is None:
        return nearest(jaccard(edges, classes), classes, None)
    heads = classes.where("src = class_id").select("src", "size")
    own = cut(edges.select("src", "dst").join(heads, "src"))
    total = own.count()
    hot = [r[0] for r in own.groupBy("dst").count().where(F.col("count") * HOT_BITS > total).select("dst").orderBy("dst").collect()]
    bits = F.broadcast(own.sparkSession.createDataFrame([(d, 1 << i) for i, d in enumerate(hot)], own.select("dst", F.lit(1).cast("bigint").alias("bit")).schema))
    sets = own.join(bits, "dst").groupBy("src").agg(F.sum("bit").alias("p"))
    sized = cut(heads.join(sets, "src", "left").select("src", "size", F.coalesce("p", F.lit(0)).cast("bigint").alias("p")))
    sim = lambda n: n / (F.col("na") + F.col("nb") - n)
    common = F.bit_count(F.col("pa").bitwiseAND(F.col("pb")))

    cold = cut(own.join(bits, "dst", "left_anti"))
    pairs = met(cold).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    a, b = (sized.select(F.col("src").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
    pairs = pairs.join(a, "a").join(b, "b").select("a", "b", sim(F.col("n") + common).alias("sim"))

    groups = cut(sized.where("p != 0").groupBy("p", "size").agg(F.min("src").alias("least")))
    each = groups.select("p", "size", "least", F.explode(F.filter(F.sequence(F.lit(0), F.lit(HOT_BITS - 1)), lambda i: F.getbit("p", i) == 1)).alias("bit"))
    one, two = each.select(F.col("p").alias("pa"), F.col("size").alias("na"), "bit"), each.select(F.col("p").alias("pb"), F.col("size").alias("nb"), "least", "bit")
    near = one.join(two, "bit").drop("bit").distinct().withColumn("sim", sim(common))
    near = best(near, ["pa", "na"], [F.round("sim", 9).desc(), F.col("least")], k + 1).drop("rank", "least")
    members = best(sized.where("p != 0").select(F.col("p").alias("pb"), F.col("size").alias("nb"), F.col("src").alias("b")), ["pb", "nb"], [F.col("b")], k + 1).drop("rank")
    few = best(near.join(members, ["pb", "nb"]), ["pa", "na"], [F.round("sim", 9).desc(), F.col("b")], k + 1).select("pa", "na", "b", "sim")
    only_hot = sized.select(F.col("src").alias("a"), F.col("p").alias("pa"), F.col("size").alias("na")).join(few, ["pa", "na"]).where("a != b").select("a", "b", "sim")
    found = pairs.unionAll(pairs.select("b", "a", "sim")).unionAll(only_hot).groupBy("a", "b").agg(F.max("sim").alias("sim"))
    return _expanded(found, classes, k)


def neighbours_of(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """All others that share a neighbour with each of the ``asked`` nodes (src): ``a``, ``b``, ``sim`` (Jaccard)."""
    sizes = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    own = edges.join(asked, "src", "left_semi").select(F.col("src").alias("a"), "dst")
    both = own.join(edges.select(F.col("src").alias("b"), "dst"), "dst").where("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    sized = both.join(sizes.select(F.col("src").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("src").alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("sim"))


def _expanded(both: DataFrame, classes: DataFrame, k: int | None) -> DataFrame:
    """Nearest nodes from the nearest classes (in both directions, without themselves)."""
    own = classes.where("src = class_id").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(1.0).alias("sim"))
    ranked = [F.round("sim", 9).desc(), F.col("b")]
    reach = None if k is None else k + 1
    some = best(both.unionAll(own), "a", ranked, reach).drop("rank")
    least = best(classes.select(F.col("class_id").alias("b"), "src"), "b", [F.col("src")], reach).drop("rank")
    spread = some.join(least, "b").select("a", F.col("src").alias("b"), "sim")
    members = classes.select("src", F.col("class_id").alias("a"))
    if k is None:
        others = members.join(spread, "a")
    else:  # a class's list has at most k+1 entries, so a large class can be looked up
        lists = best(spread, "a", ranked, reach).groupBy("a").agg(F.collect_list(F.struct("b", "sim")).alias("list"))
        others = lookup_join(members, cut(lists), "a").select("src", F.inline("list"))
    others = others.where(F.col("src") != F.col("b")).select(F.col("src").alias("a"), "b", "sim")
    return best(others, "a", ranked, k)


def array_dot(x: Column, y: Column) -> Column:
    """Inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def dense(queries: DataFrame, rows: DataFrame, key: str, vector: str, cosine: bool) -> DataFrame:
    """Similarity of each query's vector to each row's: ``a``, ``b``, ``sim``; cosine or plain inner product, a zero vector has cosine 0.

    The queries are a stated set; they go to the rows in blocks of a few thousand, each block a bounded broadcast.
    """
    own = rows.select(F.col(key).alias("b"), F.col(vector).alias("y"))
    product = array_dot(F.col("x"), F.col("y"))
    norm = F.sqrt(array_dot(F.col("x"), F.col("x"))) * F.sqrt(array_dot(F.col("y"), F.col("y")))
    sim = F.coalesce(F.try_divide(product, norm), F.lit(0.0)) if cosine else product
    return in_blocks(queries.select(F.col(key).alias("a"), F.col(vector).alias("x")), "a", lambda some: own.crossJoin(F.broadcast(some)).select("a", "b", sim.alias("sim")))


def bigraph_features(m: DataFrame, features: DataFrame, side: str, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Features of both sides of a bipartite matrix, L2-normalised, from those of one: the other side gets the sum over its neighbours.

    With ``asked`` (row) only these source nodes' own features are in the result; rows are normalised one by one, so they are the same.
    """
    if side == "source":
        source, target = features if asked is None else features.join(asked, "row", "left_semi"), matrix.times(matrix.transpose(m), features)
    elif side == "target":
        source, target = matrix.times(m, features), features
    else:
        raise ValueError('side must be "source" or "target"')
    return matrix.normalised(source, "l2"), matrix.normalised(target, "l2")
