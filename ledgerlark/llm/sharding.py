"""Sharding by balanced label propagation.

Linked documents start in some shard and move, round by round, to the shard that most of their
neighbours are in, as far as that shard's capacity allows; the moves that save most cut links go
first. Documents without links then fill what room each shard has left, so that the shards'
numbers of documents are at most one apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import documents, mark, numbered, release, saved


#: A key that more than one in so many rows have is a hot one; there are fewer hot keys than that.
HOT_SHARE = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key): rows of the few ``hot`` keys meet a broadcast of those keys' rows where they are, the others are shuffled."""
    few = F.broadcast(table.join(F.broadcast(hot.select(key)), key, "left_semi"))
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key)
    return rows.join(few, key).unionByName(others)


def equal_text_links(nodes: DataFrame, total: int, largest: int) -> DataFrame:
    """Links (a, b) that join equal texts of the ``total`` nodes (node, text_key), as stars: each document with the smallest node of its group.

    A group of more than ``largest`` documents, which no shard could hold, is dealt at random
    into as many stars as it takes, whose centres are linked with the first one's. Groups of more
    than one in HOT_SHARE documents, of which there are fewer than HOT_SHARE, are broadcast to
    their documents, so none is gathered in one task.
    """
    groups = saved(nodes.groupBy("text_key").agg(F.count("*").alias("n"), F.min("node").alias("first")).filter("n > 1"), "groups")
    bound = min(total // HOT_SHARE, largest)
    hot, cold = groups.filter(F.col("n") > bound), groups.filter(F.col("n") <= bound)
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / largest)).alias("chunk")
    members = saved(nodes.join(F.broadcast(hot), "text_key").select("node", "text_key", "first", chunk), "group-members")
    centres = saved(members.groupBy("text_key", "chunk", "first").agg(F.min("node").alias("centre")), "group-centres")
    large = members.join(F.broadcast(centres.drop("first")), ["text_key", "chunk"]).select(F.col("node").alias("a"), F.col("centre").alias("b"))
    hubs = centres.select(F.col("centre").alias("a"), F.col("first").alias("b"))
    rest = nodes.join(F.broadcast(hot.select("text_key")), "text_key", "left_anti").join(cold, "text_key").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return large.union(hubs).union(rest).filter("a <> b").distinct()


def room_for(total: int, shards: int) -> list[int]:
    """How many of ``total`` documents each shard takes: at most one apart."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def quotas(wanted: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many of the ``wanted[i][j]`` moves from shard i to j may go so that no shard ends above its room.

    Moves are taken along cycles of shards, and along paths to a shard with room, as many as the
    narrowest step allows, until there is neither; each time a step or a shard's room is used up.
    """
    shards, left, room = range(len(room)), [list(row) for row in wanted], list(room)
    allowed = [[0] * len(room) for _ in shards]
    for start in shards:
        while True:
            came, queue, last = {start: None}, [start], None
            while queue and last is None:
                i = queue.pop(0)
                for j in shards:
                    if left[i][j] and j == start:
                        last = i, True
                        break
                    if left[i][j] and j not in came:
                        came[j] = i
                        queue.append(j)
                        if room[j]:
                            last = j, False
                            break
            if last is None:
                break
            at, closed = last
            path = [at]
            while came[path[0]] is not None:
                path.insert(0, came[path[0]])
            steps = list(zip(path, [*path[1:], start] if closed else path[1:], strict=False))
            n = min(left[i][j] for i, j in steps)
            if not closed:
                n = min(n, room[at])
                room[at] -= n
                room[start] += n
            for i, j in steps:
                left[i][j] -= n
                allowed[i][j] += n
    return allowed


def spread(n: int, weights: list[float], limits: list[int]) -> list[int]:
    """``n`` as whole numbers in proportion to ``weights``, none above its limit (which have room for n together)."""
    out, left = [0] * len(limits), n
    while left:
        open_ = [s for s, limit in enumerate(limits) if out[s] < limit]
        total = sum(weights[s] for s in open_)
        parts = {s: int(left * weights[s] / total) if total > 0 else 0 for s in open_}
        if not any(parts.values()):
            parts = {s: 1 for s in sorted(open_, key=lambda s: -weights[s])[:left]}
        for s, k in parts.items():
            k = min(k, limits[s] - out[s])
            out[s] += k
            left -= k
    return out


def deal(df: DataFrame, counts: list[int]) -> DataFrame:
    """``df`` with its rows numbered (rank) and dealt: the first counts[0] to shard 0, the next counts[1] to shard 1, and so on."""
    ends = F.array(*(F.lit(sum(counts[: s + 1])).cast("long") for s in range(len(counts))))
    return numbered(df, "rank").withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col("rank"))))


def first_labels(nodes: DataFrame, capacity: list[int]) -> DataFrame:
    """(node, shard) to begin with, of ``nodes`` (node, degree, follows), within the capacities.

    The nodes with most neighbours, at most 200 a shard, go one by one to the shard that has
    fewest of their neighbours to come; other nodes that don't follow are dealt out to even that
    out, and the followers to even out the numbers of nodes.
    """
    shards = len(capacity)
    large = max(2, sum(capacity) // (100 * shards))
    ahead, held, placed = [0] * shards, [0] * shards, []
    for r in sorted(nodes.filter(~F.col("follows") & (F.col("degree") > large)).collect(), key=lambda r: (-r.degree, r.node)):
        s = min((s for s in range(shards) if held[s] < capacity[s]), key=lambda s: ahead[s] - capacity[s])
        ahead[s] += r.degree + 1
        held[s] += 1
        placed.append((r.node, s))
    counts = {r.follows: r.n for r in nodes.filter(F.col("follows") | (F.col("degree") <= large)).groupBy("follows").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values()) + len(placed)
    room = lambda used: ([max(0.0, total / shards - u) for u in used], [c - h for c, h in zip(capacity, held, strict=True)])
    labels = [nodes.sparkSession.createDataFrame(placed, "node long, shard int")]
    for follows, used in ((False, ahead), (True, held)):
        dealt = spread(counts.get(follows, 0), *room(used))
        kind = nodes.filter("follows" if follows else f"NOT follows AND degree <= {large}")
        labels.append(deal(kind.select("node"), dealt).select("node", "shard"))
        held[:] = [h + d for h, d in zip(held, dealt, strict=True)]
    return labels[0].union(labels[1]).union(labels[2])


def cut_links(links: DataFrame, labels: DataFrame, hot: DataFrame) -> int:
    """How many ``links`` (a, b) join nodes of different shards."""
    ends = links.select("a", "b")
    for c in "ab":
        ends = spread_join(ends, labels.select(F.col("node").alias(c), F.col("shard").alias(f"shard_{c}")), c, hot.select(F.col("node").alias(c)))
    return ends.filter("shard_a <> shard_b").count()


def propagate(links: DataFrame, capacity: list[int], patience: int = 4) -> DataFrame:
    """(node, shard) of every node of ``links`` (a, b), with at most ``capacity[s]`` nodes in shard s.

    It begins with first_labels(). In odd rounds a node with one link may follow its neighbour
    (of two such nodes, the one with the larger number), in even rounds half of the others may
    move. quotas() of the numbers that want from each shard into each other says how many may;
    the moves that save most links go first. It ends when no link is cut, after two rounds in a
    row without a move, or when the cut links have not become fewer for ``patience`` rounds; the
    labels with fewest cut links are the result. The driver gets those numbers, as many as pairs
    of shards, and the nodes with most links, at most 200 a shard.
    """
    shards, began = len(capacity), mark()
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degrees = saved(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.max("b").alias("other")), "degrees")
    heavy = saved(degrees.filter(F.col("degree") > max(1, links.count() * 2 // HOT_SHARE)).select("node"), "heavy")
    at = lambda c: heavy.select(F.col("node").alias(c))
    other = degrees.select(F.col("node").alias("other"), F.col("degree").alias("other_degree"))
    follows = spread_join(degrees.filter("degree = 1"), other, "other", at("other")).filter("other_degree > 1 OR node > other").select("node", F.lit(True).alias("follows"))
    nodes = saved(degrees.select("node", "degree").join(follows, "node", "left").withColumn("follows", F.coalesce("follows", F.lit(False))), "nodes")
    labels = first = saved(first_labels(nodes, capacity), "labels")
    links_of = saved(spread_join(both, nodes.select(F.col("node").alias("a"), "follows"), "a", at("a")).select("a", "b", "follows"), "links")
    fewest, best, idle, stale, step = cut_links(links, labels, heavy), labels, 0, 0, 0
    each = mark()
    while fewest and idle < 2 and stale < patience:
        step += 1
        active = F.col("follows") if step % 2 else ~F.col("follows") & (F.pmod(F.xxhash64("a", F.lit(step)), F.lit(2)) == 0)
        near = spread_join(links_of.filter(active).select("a", "b"), labels.select(F.col("node").alias("b"), F.col("shard").alias("near")), "b", at("b"))
        votes = near.groupBy("a", "near").agg(F.count("*").alias("n")).join(labels.select(F.col("node").alias("a"), "shard"), "a")
        own = F.max(F.when(F.col("near") == F.col("shard"), F.col("n")).otherwise(0))
        wish = votes.groupBy("a", "shard").agg(F.max(F.struct("n", (-F.col("near")).alias("near"))).alias("best"), own.alias("own"))
        movers = wish.filter("best.n > own").select(F.col("a").alias("node"), F.col("shard").alias("old"), (-F.col("best.near")).alias("new"), (F.col("best.n") - F.col("own")).alias("gain"))
        order = ["old", "new", F.desc("gain"), F.xxhash64("node")]
        movers = numbered(movers.repartitionByRange(*order).sortWithinPartitions(*order), "rank")
        wanted = [[0] * shards for _ in capacity]
        for r in movers.groupBy("old", "new").agg(F.count("*").alias("n")).collect():
            wanted[r.old][r.new] = r.n
        loads = {r.shard: r.n for r in labels.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        allowed = quotas(wanted, [c - loads.get(s, 0) for s, c in enumerate(capacity)])
        if not any(map(any, allowed)):
            idle += 1
            continue
        idle, ends, total = 0, [], 0
        for row, may in zip(wanted, allowed, strict=True):
            for n, k in zip(row, may, strict=True):
                ends.append(total + k)
                total += n
        end = F.element_at(F.array(*(F.lit(e).cast("long") for e in ends)), (F.col("old") * shards + F.col("new") + 1).cast("int"))
        moves = movers.filter(F.col("rank") < end).select("node", "new")
        labels = saved(labels.join(moves, "node", "left").select("node", F.coalesce("new", "shard").alias("shard")), "labels")
        cut = cut_links(links, labels, heavy)
        stale = 0 if cut < fewest else stale + 1
        if cut < fewest:
            fewest, best = cut, labels
        release(links.sparkSession, each, (best, labels) if best is not first else (labels,))
    release(links.sparkSession, began, (best,))
    return best


def balanced_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot and grown_shard.

    The law is ``rows``: the shards' numbers of documents are at most one apart. Equal texts are
    linked, and stay in one shard as far as they fit. ``slot`` numbers the documents of a shard
    from 0 without gaps; ``size`` is the text's UTF-8 bytes plus 16; ``grown_shard`` is null.

    A null text is an empty one. Rows are told apart by their place, not their doc_id, so null
    doc_ids and repeated rows each get a slot. Texts of any length count as one document. Ties
    between moves that save as many links go by a hash of the node, ties between shards to the
    lower one. Other columns, whatever their names, are not read. An empty table gives no rows.
    Texts are not shuffled, only their 128-bit digests.
    """
    text = F.coalesce("text", F.lit(""))
    crc = F.crc32(text.cast("binary")).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), crc.alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"))
    nodes = saved(numbered(rows, "node"), "nodes")
    total = nodes.count()
    capacity = room_for(total, shards)
    links = saved(equal_text_links(nodes.select("node", "text_key"), total, max(1, min(capacity) * 9 // 10)), "links")
    labels = propagate(links, capacity)
    loads = {r.shard: r.n for r in labels.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    linked = [loads.get(s, 0) for s in range(shards)]
    free = [capacity[s] - linked[s] for s in range(shards)]
    starts = lambda sizes: [sum(sizes[:s]) for s in range(shards)]
    of = lambda values, s: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), s + 1)

    placed = numbered(labels.repartitionByRange("shard", "node").sortWithinPartitions("shard", "node"), "rank")
    placed = placed.select("node", "shard", (F.col("rank") - of(starts(linked), F.col("shard"))).alias("slot"))
    loose = deal(nodes.select("node").join(labels.select("node"), "node", "left_anti"), free)
    loose = loose.select("node", "shard", (F.col("rank") - of(starts(free), F.col("shard")) + of(linked, F.col("shard"))).alias("slot"))
    out = nodes.join(placed.union(loose), "node")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_balanced_shards(spark, sf_dir):
    """All documents in 40 shards of equal numbers of documents."""
    return balanced_shards(documents(spark, sf_dir))
