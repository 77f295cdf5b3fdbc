"""Prefix tree of conversations by partition refinement.

All conversations start in one class. In each round a class goes on over the turns that all
its members share, and is then split by the next turn; a class of one conversation
retires, and the rest of it is a chain of nodes. Afterwards leaves and savings are folded
back from the last round to the first. A round goes on to the next place where members differ,
so there are as many rounds as branchings on one way from the root, not as many as turns; and a
class that has few turns left is refined to its end in one task.

Equal conversations are one with a weight. Turns travel as digests of 128 bits with their
sizes; texts don't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, crc32_sql, release, table

#: Ids of a range of conv_id so many bits wide are joined to one text before they are hashed.
RANGE = 12
#: Most turns left in a class that one task finishes; larger classes are split by turn all over the cluster.
LOCAL = 20_000
#: Fixed values of the rebuilding: conversations share the first turns of the one whose number is the
#: next lower multiple of FAMILY, so many as the crc32 of their number leaves modulo HEAD.
FAMILY, HEAD = 5, 9


def _labelled(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, label (digest of role and text), bytes of the text and copies of equal turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    label = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), label.alias("label"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.where("conv_id is not null").groupBy("conv_id", "turn", "label", "bytes").agg(F.count("*").alias("copies"))


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, d (from 1), label, bytes and upto (bytes of the turns so far) of each turn, by turn (null first), ties
    by the digest of role and text; checkpointed.

    Turns are dealt out by ranges of conversation and turn, and counted in each range first, so that one
    conversation may have any share of all rows."""
    lanes = _labelled(conversations).repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "label").withColumn("lane", F.spark_partition_id())
    rows = checkpoint(lanes)
    sums = rows.groupBy("conv_id", "lane").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("bytes")).alias("b"))
    before = "coalesce(sum({0}) over (partition by conv_id order by lane rows between unbounded preceding and 1 preceding), 0)"
    offsets = sums.select("conv_id", "lane", F.expr(before.format("n")).alias("n0"), F.expr(before.format("b")).alias("b0"))
    inside = "coalesce(sum({0}) over (partition by conv_id, lane order by turn nulls first, label rows between unbounded preceding and 1 preceding), 0)"
    rows = rows.select("*", F.expr(inside.format("copies")).alias("n1"), F.expr(inside.format("copies * bytes")).alias("b1")).join(offsets, ["conv_id", "lane"])
    each = rows.select("conv_id", "label", "bytes", "n0", "n1", "b0", "b1", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("c"))
    return checkpoint(each.select("conv_id", (F.col("n0") + F.col("n1") + F.col("c")).alias("d"), "label", "bytes", (F.col("b0") + F.col("b1") + F.col("c") * F.col("bytes")).alias("upto")))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as placed() gives them, and conv_id and n (turns) of each conversation, after the first turns of each
    are replaced by those of its family's first; both checkpointed.

    A conversation c gets the first h turns of conversation c - c % FAMILY (all, if it has fewer; none, if it isn't
    there) in place of its own first h, h being crc32(c as decimal) % HEAD; % keeps the sign of c, as in SQL."""
    turns = placed(conversations)
    # of each conversation at most HEAD - 1 turns meet in one row
    head = F.array_sort(F.collect_list(F.when(F.col("d") < HEAD, F.struct("d", "label", "bytes", "upto"))))
    convs = checkpoint(turns.groupBy("conv_id").agg(F.max("d").alias("own"), head.alias("head")))
    named = convs.selectExpr("conv_id", "own", "head as mine", f"conv_id - conv_id % {FAMILY} as first", f"cast(crc32(cast(conv_id as string)) % {HEAD} as int) as h")
    named = named.join(convs.selectExpr("conv_id as first", "head"), "first", "left").withColumn("head", F.expr("slice(coalesce(head, array()), 1, h)"))
    named = named.selectExpr("conv_id", "own", "h", "head", "size(head) as taken", "coalesce(try_element_at(head, -1).upto, 0) - coalesce(try_element_at(slice(mine, 1, h), -1).upto, 0) as moved")
    named = checkpoint(named.withColumn("n", F.expr("taken + greatest(0, own - h)").cast("long")))
    later = turns.join(named.select("conv_id", "h", "taken", "moved"), "conv_id").where("d > h").selectExpr("conv_id", "d - h + taken as d", "label", "bytes", "upto + moved as upto")
    return checkpoint(named.select("conv_id", F.inline("head")).select("conv_id", "d", "label", "bytes", "upto").union(later)), named.select("conv_id", "n")


def _ends(groups: DataFrame) -> DataFrame:
    """rep and ends, the hex SHA-256 of the conv_ids of each group of groups(rep, conv_id), ascending and joined by commas.

    Ids are joined by ranges first; then a group's ranges are hashed in order as they pass, so memory is bounded, however
    large the group."""
    lanes = groups.withColumn("lane", F.shiftright("conv_id", RANGE)).groupBy("rep", "lane").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            reps, ends = [], []
            for rep, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rep == now:
                    digest.update(b"," + ids.encode())
                    continue
                if digest is not None:
                    reps.append(now)
                    ends.append(digest.hexdigest())
                now, digest = rep, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(ends, pa.string())], ["rep", "ends"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([digest.hexdigest()])], ["rep", "ends"])
        release()

    return lanes.repartition("rep").sortWithinPartitions("rep", "lane").select("rep", "ids").mapInArrow(run, "rep bigint, ends string")


def _refined(rest: DataFrame, reps: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame] | None:
    """The chains of each round: conv_id (smallest member), top and bottom (depths), n (members), parent and parent_top
    (its parent's chain); the ends: rep, conv_id and d, the node at which a conversation ends; and the members of
    classes that one task can finish. None, if there is no conversation.

    rest has the turns (conv_id, d, label) of reps(conv_id, n, weight), all different."""
    root = reps.agg(F.min("conv_id").alias("class"), F.count("*").alias("k"), F.sum("weight").alias("n"), F.sum(F.col("n") + 1).alias("turns")).where("k > 0")
    classes = checkpoint(root.selectExpr("class", "0L as top", "k", "n", "turns", "cast(null as bigint) as parent", "cast(null as bigint) as parent_top"))
    if classes.isEmpty():
        return None
    known = "class", "top", "k", "n", "turns", "parent", "parent_top"
    members, rounds, ends, small = reps.selectExpr("conv_id", "weight", "n as last").join(F.broadcast(classes)), [], [], []  # one row
    members = checkpoint(members)
    while True:
        alone = members.where("k = 1")
        ends.append(alone.selectExpr("conv_id as rep", "class as conv_id", "last as d"))
        small.append(members.where(f"k > 1 and turns <= {LOCAL}").withColumn("round", F.lit(len(rounds))))
        chains = alone.selectExpr("class as conv_id", "top", "last as bottom", "n", "parent", "parent_top")
        large = members.where(f"k > 1 and turns > {LOCAL}")
        if large.isEmpty():
            return [*rounds, chains], reduce(DataFrame.union, ends), reduce(DataFrame.union, small)
        # what large classes still have; the others' turns aren't read again
        rest = checkpoint(rest.select("conv_id", "d", "label").join(large, "conv_id").where("d > top"))
        agreed = rest.groupBy("class", "d").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high"), F.max("k").alias("k"))
        # members differ, so there is a turn that not all of them have alike
        split = checkpoint(agreed.where("m < k or low <> high").groupBy("class").agg(F.min("d").alias("next")))
        ends.append(large.join(split, "class").where("last = next - 1").selectExpr("conv_id as rep", "class as conv_id", "last as d"))
        through = classes.where(f"k > 1 and turns > {LOCAL}").join(split, "class").selectExpr("class as conv_id", "top", "next - 1 as bottom", "n", "parent", "parent_top")
        rounds.append(chains.union(through))
        here = rest.join(split, "class").where("d = next").select("conv_id", "class", "label", "weight", "last", "top", "next")
        parts = here.groupBy("class", "label").agg(F.min("conv_id").alias("new"), F.count("*").alias("k"), F.sum("weight").alias("n"), F.sum(F.col("last") - F.col("next") + 1).alias("turns"), F.max("top").alias("parent_top"), F.max("next").alias("top"))
        parts = checkpoint(parts)
        members = checkpoint(here.select("conv_id", "weight", "last", "class", "label").join(parts, ["class", "label"]).selectExpr("conv_id", "weight", "last", "new as class", "top", "k", "n", "turns", "class as parent", "parent_top"))
        classes = parts.selectExpr("new as class", "top", "k", "n", "turns", "class as parent", "parent_top").select(*known)


#: Columns of finished chains: start and end are bytes up to before the top and up to the bottom, saved_below is of the subtrees under it.
_CHAIN = "conv_id bigint, top bigint, bottom bigint, n bigint, parent bigint, parent_top bigint, start bigint, end bigint, children bigint, leaves bigint, saved_below bigint"


def _finished(small: DataFrame, own: DataFrame) -> DataFrame:
    """Chains and ends of small classes, refined in one task each: kind 0 is a class's first chain, 1 a further one, 2 an end (of
    conversation n at conv_id and bottom); and the round the class comes from; checkpointed."""
    turns = small.select("conv_id", "weight", "last", "class", "top", "parent", "parent_top", "round").join(own.select("conv_id", "d", "label", "bytes", "upto"), "conv_id", "left").where("d is null or d >= least(top, last)")

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        _, top, parent, parent_top, level = (k.as_py() for k in key)
        weight, last, label, bytes_upto = {}, {}, {}, {}
        for conv, w, n, d, x, size, upto in zip(*(rows[c].to_pylist() for c in ("conv_id", "weight", "last", "d", "label", "bytes", "upto"))):
            weight[conv], last[conv] = w, n
            if d is not None:
                label[conv, d], bytes_upto[conv, d] = x, (size, upto)
        chains, ends, todo = [], [], [(sorted(weight), top, parent, parent_top)]
        while todo:
            members, at, above, above_top = todo.pop()
            lead, bottom = members[0], at
            while bottom < last[lead] and all(label.get((c, bottom + 1)) == label[lead, bottom + 1] for c in members[1:]):
                bottom += 1
            ends += [(c, lead, bottom) for c in members if last[c] == bottom]
            parts: dict[bytes, list[int]] = {}
            for c in members:
                if last[c] > bottom:
                    parts.setdefault(label[c, bottom + 1], []).append(c)
            todo += [(m, bottom + 1, lead, at) for m in parts.values()]
            size, upto = bytes_upto.get((lead, at), (0, 0))
            chains.append([lead, at, bottom, sum(weight[c] for c in members), above, above_top, upto - size, bytes_upto.get((lead, bottom), (0, 0))[1], len(parts), 0, 0])
        place = {(c[0], c[1]): c for c in chains}
        for c in reversed(chains):
            c[9] = c[9] or 1
            if c is not chains[0]:
                up = place[c[4], c[5]]
                up[9] += c[9]
                up[10] += (c[3] - 1) * (c[7] - c[6]) + c[10]
        out = [[int(k > 0), *c] for k, c in enumerate(chains)] + [[2, node, 0, d, c, None, None, 0, 0, 0, 0, 0] for c, node, d in ends]
        columns = [pa.array(x, pa.int64()) for x in zip(*out)]
        return pa.Table.from_arrays([*columns, pa.array([level] * len(out), pa.int32())], names)

    schema = f"kind bigint, {_CHAIN}, round int"
    names = [x.split()[0] for x in schema.split(", ")]
    return checkpoint(turns.groupBy("class", "top", "parent", "parent_top", "round").applyInArrow(run, schema))


def _folded(rounds: list[DataFrame], finished: DataFrame, upto: DataFrame) -> DataFrame:
    """The chains of all rounds and of finished classes, as _CHAIN has them. upto has conv_id, d and upto."""
    names = [x.split()[0] for x in _CHAIN.split(", ")]
    at = lambda name, d: upto.select("conv_id", F.col("d").alias(d), F.col("upto").alias(name))
    below, out = None, [finished.where("kind < 2").select(*names)]
    for level in range(len(rounds) - 1, -1, -1):
        # what comes before the top and up to the bottom; nothing does at the root
        rows = rounds[level].withColumn("before", F.col("top") - 1).join(at("start", "before"), ["conv_id", "before"], "left").join(at("end", "bottom"), ["conv_id", "bottom"], "left")
        if below is not None:
            rows = rows.join(below, ["conv_id", "top"], "left")
        zero = {"start": 0, "end": 0, "children": 0, "leaves": 1, "saved_below": 0}
        rows = checkpoint(rows.withColumns({c: F.coalesce(*([F.col(c)] if c in rows.columns else []), F.lit(v)).cast("long") for c, v in zero.items()}).select(*names))
        out.append(rows)
        every = rows.union(finished.where(f"kind = 0 and round = {level}").select(*names)).where("parent is not null")
        below = every.groupBy(F.col("parent").alias("conv_id"), F.col("parent_top").alias("top")).agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum(F.expr("(n - 1) * (end - start) + saved_below")).alias("saved_below"))
    return reduce(DataFrame.union, out)


def prefix_tree(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node of the tree of all conversations' beginnings.

    turns has conv_id, d, label, bytes and upto as placed() gives them, convs conv_id and n for each conversation, also
    those without turns. Gives conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves, saved_tokens (bytes that members after the first share, over the subtree) and ends_sha256 (of the members that
    end here). A null conv_id is no conversation; null role and text are empty; equal turns of a
    conversation are as many turns; an empty table gives no node. Conversations of any length and groups of
    copies of any size are dealt out by turn and counted before they meet."""
    # equal conversations: equal numbers of turns and 128 bits of their placed turns; no two turns of one are equal with their place
    mark = turns.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("d", "label")).alias("x"), F.bit_xor(F.xxhash64("label", "d", F.lit(1))).alias("y"))
    marked = convs.join(mark, "conv_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("x", "y")})
    same = checkpoint(marked.groupBy("n", "x", "y").agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight")))
    reps = same.selectExpr("rep as conv_id", "n", "weight")
    own = checkpoint(turns.join(reps.select("conv_id"), "conv_id", "left_semi"))
    refined = _refined(own, reps)
    if refined is None:
        return reps.selectExpr("conv_id", "n as depth", "n as parent_conv_id", "n as n_convs", "n as n_children", "n as n_leaves", "n as saved_tokens", "'' as ends_sha256")
    rounds, last, small = refined
    finished = _finished(small, own)
    chains = _folded(rounds, finished, own.select("conv_id", "d", "upto"))
    last = last.union(finished.where("kind = 2").selectExpr("n as rep", "conv_id", "bottom as d"))
    groups = marked.join(same, ["n", "x", "y"]).select("rep", "conv_id", "weight")
    ends = groups.where("weight = 1").select("rep", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends")).union(_ends(groups.where("weight > 1").select("rep", "conv_id")))
    root = chains.where("top = 0").selectExpr("conv_id", "0L as d", "0L as bytes", "0L as upto")
    nodes = own.select("conv_id", "d", "bytes", "upto").union(root).join(chains, "conv_id").where("d between top and bottom")
    nodes = nodes.join(last.join(ends, "rep").select("conv_id", "d", "ends"), ["conv_id", "d"], "left")
    children = F.when(F.col("d") < F.col("bottom"), 1).otherwise(F.col("children")).cast("long")
    saved = F.expr("(n - 1) * (end - upto + bytes) + saved_below").cast("long")
    parent = F.when(F.col("d") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent"))
    ended = F.coalesce("ends", F.sha2(F.lit(""), 256))
    return nodes.select("conv_id", F.col("d").alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), children.alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"), saved.alias("saved_tokens"), ended.alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree(*rebuilt(table(spark, sf_dir, "conversations")))


SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) d, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} x FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(x ORDER BY d) s FROM t GROUP BY 1),
h AS (SELECT conv_id, s, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 h FROM l),
r AS (SELECT h.conv_id, list_concat(coalesce(l.s[1 : h], []), h.s[h + 1 :]) s FROM h LEFT JOIN l ON l.conv_id = h.conv_id - h.conv_id % 5),
e AS (SELECT conv_id, len(s) n, unnest(range(0, len(s) + 1)) d, s FROM r),
p AS (SELECT conv_id, n, d, s[1 : d] k, strlen(s[d].t) b FROM e),
g AS (SELECT k, d, min(conv_id) id, count(*) n, coalesce(max(b), 0) b, string_agg(CASE WHEN n = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) ends FROM p GROUP BY k, d),
w AS (SELECT g.*, q.id parent, q.d up FROM g LEFT JOIN g q ON q.d = g.d - 1 AND q.k = g.k[1 : g.d - 1]),
c AS (SELECT parent, up, count(*) children FROM w GROUP BY 1, 2),
n AS (SELECT w.*, coalesce(children, 0) children FROM w LEFT JOIN c ON c.parent = w.id AND c.up = w.d),
a AS (SELECT id, d, unnest(range(0, d + 1)) z, k, n, b, children FROM n),
f AS (SELECT k[1 : z] k, z, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) leaves, sum((n - 1) * b) saved FROM a GROUP BY 1, 2)
SELECT n.id conv_id, n.d depth, n.parent parent_conv_id, n.n n_convs, n.children n_children, CAST(leaves AS BIGINT) n_leaves, CAST(saved AS BIGINT) saved_tokens, sha256(coalesce(ends, '')) ends_sha256
FROM n JOIN f ON f.k = n.k AND f.z = n.d
"""
