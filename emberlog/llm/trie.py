"""A trie of conversation prefixes: a z-fast trie built in batches, whose edges are expanded to a row per prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import discard, stored

#: A turn within a sequence: the fingerprint of all up to it, its characters, and those of all up to it.
TURN = "struct<fp:binary,chars:long,total:long>"
#: Keys that are joined to one string before their digest is taken.
JOINED = 4096


def conversations(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): every conversation's turns in order, each as a hash of role and text and the text's number of characters.

    Ordered by ``turn``, null first, then by role and by the text's hash; null roles and texts are empty, repeated rows are
    repeated turns. Rows with a null key belong to no conversation. A conversation is one value, at 50 bytes a turn.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    said = F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"), role_.alias("role"), F.xxhash64(role_, text_).alias("h1"),
                    F.xxhash64(F.lit(1), role_, text_).alias("h2"), F.char_length(text_).cast("long").alias("chars"))
    ordered = F.transform(F.sort_array(F.collect_list(said)), lambda t: F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["chars"].alias("chars")))
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(ordered.alias("turns"))


def sequences(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, sid, path): ``path`` has a TURN for each turn, ``sid`` is the fingerprint of the whole conversation.

    Each fingerprint is a 128-bit hash of the one before and the turn, so equal fingerprints mean equal prefixes.
    """
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("fp", pa.binary()), ("chars", pa.int64()), ("total", pa.int64())]))
        for batch in batches:
            sids, paths = [], []
            for turns in batch.column(1).to_pylist():
                fp, total, path = b"", 0, []
                for t in turns:
                    digest = fp + t["h1"].to_bytes(8, "little", signed=True) + t["h2"].to_bytes(8, "little", signed=True)
                    fp, total = hashlib.blake2b(digest, digest_size=16).digest(), total + t["chars"]
                    path.append((fp, t["chars"], total))
                sids.append(fp)
                paths.append([dict(zip(("fp", "chars", "total"), p)) for p in path])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sids, pa.binary()), pa.array(paths, kind)], ["key", "sid", "path"])

    kind = convs.schema[key].dataType.simpleString()
    return convs.select(key, "turns").mapInArrow(chain, f"key {kind}, sid binary, path array<{TURN}>")


def fattest(low: str, high: str) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    shift = f"(length(bin({low} ^ {high})) - 1)"
    return F.expr(f"shiftleft(shiftright({high}, {shift}), {shift})")


def _nodes(rows: DataFrame) -> DataFrame:
    """Nodes from (low, high, above, edge, sid): the turns after ``low`` up to ``high`` lie on the edge from the parent.

    ``above`` and ``end`` are the fingerprints at both ends of the edge and name the parent and the node, ``name`` the one of the
    first turn on it; ``handle`` is the one at depth ``hand``, the two-fattest of the edge, under which the node is hashed.
    """
    rows = rows.withColumn("hand", fattest("low", "high"))
    at = lambda depth: F.element_at("edge", (depth - F.col("low")).cast("int"))["fp"]
    return rows.select("low", "high", "above", "edge", "sid", at(F.col("low") + 1).alias("name"), at(F.col("high")).alias("end"), "hand",
                       at(F.col("hand")).alias("handle"))


def _locate(open_: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """``open_`` with ``at``, the depth of the deepest node that lies on each sequence, found by fat binary search.

    Each step looks up the fingerprint at the two-fattest depth of the interval left among the handles; a step halves what can
    follow, so the bits of the greatest length are enough.
    """
    handles = nodes.select(F.col("hand").alias("_hand"), F.col("handle").alias("_handle"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("end").alias("_end"))
    now = open_.withColumns({"at": F.lit(0), "_to": F.col("m")})
    for _ in range(steps):
        # a sequence whose search is over asks for a depth that no node has
        now = now.withColumn("_try", F.when(F.col("at") < F.col("_to"), fattest("at", "_to")).otherwise(0))
        now = now.withColumn("_key", F.when(F.col("_try") > 0, F.element_at("path", F.greatest("_try", F.lit(1)))["fp"]).otherwise(F.col("sid")))
        now = now.join(handles, (F.col("_key") == F.col("_handle")) & (F.col("_try") == F.col("_hand")), "left")
        hit = F.col("_hand").isNotNull()
        on = hit & (F.col("_high") <= F.col("m")) & (F.get("path", F.col("_high") - 1)["fp"] == F.col("_end"))
        now = now.withColumns({
            "at": F.when(on, F.col("_high")).when(hit, F.col("_low")).otherwise(F.col("at")),
            "_to": F.when(on, F.col("_to")).when(hit, F.col("_low")).when(F.col("_try") > 0, F.col("_try") - 1).otherwise(F.col("_to")),
        }).drop("_try", "_key", *handles.columns)
    return now.drop("_to")


def _insert(located: DataFrame, nodes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The nodes with a batch of sequences put in, and the sequences that have to wait for the next batch.

    A sequence leaves the trie at a node or on the edge to its child. The edge is cut wherever one leaves it; of the sequences
    that leave at a place with the same next turn the one with the least ``sid`` becomes a leaf, the others wait for it.
    """
    next_ = lambda depth: F.get("path", depth)["fp"]
    if nodes is not None:
        children = nodes.select(F.col("name").alias("_name"), F.col("low").alias("_low"), F.col("high").alias("_high"), F.col("edge").alias("_edge"))
        ask = F.coalesce(next_(F.col("at")), F.col("sid"))
        left = located.withColumn("_ask", ask).join(children, (F.col("_ask") == F.col("_name")) & (F.col("at") == F.col("_low")), "left")
        beside = F.zip_with("_edge", F.slice("path", F.col("at") + 1, F.greatest(F.size("_edge"), F.lit(0))), lambda a, b: a["fp"] == b["fp"])
        shared = F.coalesce(F.size(F.filter(beside, lambda same: same)), F.lit(0))  # equal up to a place, then never again
        left = left.withColumn("leaves", F.col("at") + F.when(F.col("_name").isNull(), 0).otherwise(shared))
        left = stored(left.select(*located.columns, "leaves", "_name", "_high"), "trie_left")
        cuts = left.filter((F.col("leaves") > F.col("at")) & (F.col("leaves") < F.col("_high"))).groupBy("_name").agg(F.sort_array(F.collect_set("leaves")).alias("_cuts"))
        whole = nodes.join(cuts, F.col("name") == F.col("_name"), "left")
        ends = F.concat(F.array("low"), F.coalesce("_cuts", F.array().cast("array<int>")), F.array("high"))
        whole = whole.withColumn("_ends", ends).withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_ends") - 1)))
        end = lambda i: F.element_at("_ends", i)
        start = end(F.col("_i")) - F.col("low")
        pieces = whole.select(
            end(F.col("_i")).alias("low"), end(F.col("_i") + 1).alias("high"), F.when(F.col("_i") == 1, F.col("above")).otherwise(F.get("edge", start - 1)["fp"]).alias("above"),
            F.slice("edge", start + 1, end(F.col("_i") + 1) - end(F.col("_i"))).alias("edge"), "sid")
    else:
        left, pieces = located.withColumn("leaves", F.col("at")), None
    more = left.filter(F.col("leaves") < F.col("m")).withColumn("_next", next_(F.col("leaves")))
    first = stored(more.groupBy("_next").agg(F.min("sid").alias("sid")), "trie_first")
    new = more.join(first.drop("_next"), "sid").select(
        F.col("leaves").alias("low"), F.col("m").alias("high"), F.get("path", F.col("leaves") - 1)["fp"].alias("above"),
        F.slice("path", F.col("leaves") + 1, F.col("m") - F.col("leaves")).alias("edge"), "sid")
    after = stored(_nodes(new if pieces is None else pieces.unionByName(new)), "trie_nodes")
    waiting = stored(more.join(first.drop("_next"), "sid", "left_anti").select("sid", "m", "path"), "trie_waiting")
    discard(first)
    if nodes is not None:
        discard(left)
    return after, waiting


def build(distinct: DataFrame) -> DataFrame | None:
    """The compacted nodes of a z-fast trie over distinct sequences (sid, m, path), none empty; None if there is no sequence.

    Every sequence ends at a node. A batch is all sequences that are not yet in: each adds a leaf for every place and next turn
    at which any leaves the trie, so there are as many batches as nodes that branch on one path, at most.
    """
    longest = distinct.agg(F.max("m")).first()[0]
    if longest is None:
        return None
    nodes, waiting = _insert(distinct.select("sid", "m", "path").withColumn("at", F.lit(0)), None)
    while not waiting.isEmpty():
        after, later = _insert(_locate(waiting, nodes, int(longest).bit_length()), nodes)
        discard(nodes), discard(waiting)
        nodes, waiting = after, later
    return nodes


def joined_digests(members: DataFrame) -> DataFrame:
    """(sid, ends_sha256): the SHA-256 of each group's keys, ascending and joined by commas, for members (sid, key).

    Keys are dealt out in ranges of group and key, so a group of any size is joined by many tasks; one task then reads a group's
    joined pieces in order and holds one at a time.
    """
    ranges = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out, i = batch.to_pylist(), [], 0
            while i < len(rows):
                j = i
                while j < len(rows) and j - i < JOINED and rows[j]["sid"] == rows[i]["sid"]:
                    j += 1
                out.append((rows[i]["sid"], rows[i]["key"], ",".join(str(r["key"]) for r in rows[i:j])))
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((), (), ()), (pa.binary(), pa.int64(), pa.string()))], ["sid", "key", "part"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, state = None, None
        done: list[tuple[bytes, str]] = []
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["sid"] != sid:
                    if state is not None:
                        done.append((sid, state.hexdigest()))
                    sid, state = row["sid"], hashlib.sha256(row["part"].encode())
                else:
                    state.update(b"," + row["part"].encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.binary(), pa.string()))], ["sid", "ends_sha256"])
            done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([sid], pa.binary()), pa.array([state.hexdigest()])], ["sid", "ends_sha256"])

    rows = members.select("sid", F.col("key").cast("long").alias("key"))
    parts = rows.repartitionByRange(ranges, "sid", "key").sortWithinPartitions("sid", "key").mapInArrow(join, "sid binary, key long, part string")
    return parts.repartition(ranges, "sid").sortWithinPartitions("sid", "key").mapInArrow(digest, "sid binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, key: str = "conv_id") -> DataFrame:
    """A row per distinct prefix of conversations (key, turns as ``conversations`` makes them), from the root of depth 0.

    Columns, all but the digest long: the smallest key among the conversations that start with the prefix (``key``), depth,
    parent_<key> (the smallest one of the parent, null for the root), n_convs (how many start with it), n_children, n_leaves
    (prefixes below that nothing follows, itself included), saved_tokens (over all prefixes from it on down, characters of the
    last turn times the conversations but one), ends_sha256 (of the keys of conversations that are the prefix, ascending and
    joined by commas; of the empty text if none). A conversation without turns is the root. Keys are whole numbers, each in one
    row; an empty table gives an empty one.
    """
    members = stored(sequences(convs, key), "trie_members")
    distinct = stored(members.withColumn("m", F.size("path")).groupBy("sid", "m").agg(
        F.any_value("path").alias("path"), F.count(F.lit(1)).alias("n"), F.min("key").alias("least")), "trie_sequences")
    digests = stored(joined_digests(members), "trie_digests")
    root = distinct.agg(F.min("least"), F.sum("n")).first()
    spark = convs.sparkSession
    columns = [key, "depth", f"parent_{key}", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shape = ", ".join([*(f"{c} long" for c in columns[:-1]), "ends_sha256 string"])
    nothing = hashlib.sha256(b"").hexdigest()
    if root[1] is None:
        return spark.createDataFrame([], shape)
    top = digests.filter(F.col("sid") == F.lit(b"")).first()
    top_digest = top["ends_sha256"] if top else nothing
    nodes = build(distinct.filter("m > 0"))
    if nodes is None:
        return spark.createDataFrame([(root[0], 0, None, root[1], 0, 1, 0, top_digest)], shape)

    # every node with itself and the nodes above it: those at whose depth the sequence that made it has their fingerprint
    lines = nodes.select("sid", "high", "end").join(distinct.select("sid", "path"), "sid")
    steps = lines.select("end", F.explode(F.slice("path", 1, F.col("high"))["fp"]).alias("over"))
    over = stored(steps.join(nodes.select(F.col("end").alias("over")), "over"), "trie_over")
    ended = nodes.select("end").join(distinct.select(F.col("sid").alias("end"), "n", "least"), "end", "left")
    counted = stored(over.join(ended, "end").groupBy(F.col("over").alias("end")).agg(F.sum("n").alias("n_convs"), F.min("least").alias("least")), "trie_counts")
    children = nodes.filter("above is not null").groupBy(F.col("above").alias("end")).agg(F.count(F.lit(1)).alias("n_children"))
    known = nodes.join(counted, "end").join(children, "end", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    length = F.aggregate("edge", F.lit(0).cast("long"), lambda n, t: n + t["chars"])
    known = stored(known.withColumn("own", (F.col("n_convs") - 1) * length).withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie_known")
    below = over.join(known.select("end", "own", "leaf"), "end").groupBy(F.col("over").alias("end")).agg(F.sum("own").alias("saved"), F.sum("leaf").alias("n_leaves"))
    parents = known.select(F.col("end").alias("above"), F.col("least").alias("_parent"))
    full = known.join(below, "end").join(parents, "above", "left").join(digests.withColumnRenamed("sid", "end"), "end", "left")

    last = F.col("i") == F.size("edge") - 1
    rest = F.element_at("edge", -1)["total"] - F.col("t.total") + F.col("t.chars")  # characters from this turn on to the node
    rows = full.select("*", F.posexplode("edge").alias("i", "t")).select(
        F.col("least").alias(key), (F.col("low") + F.col("i") + 1).cast("long").alias("depth"),
        F.when(F.col("i") > 0, F.col("least")).otherwise(F.coalesce("_parent", F.lit(root[0]))).alias(f"parent_{key}"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - F.col("own") + (F.col("n_convs") - 1) * rest).alias("saved_tokens"),
        F.when(last & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(nothing).alias("ends_sha256"))
    whole = known.agg(F.count(F.when(F.col("low") == 0, 1)).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("own").alias("saved_tokens"))
    head = whole.select(F.lit(root[0]).alias(key), F.lit(0).alias("depth"), F.lit(None).alias(f"parent_{key}"), F.lit(root[1]).alias("n_convs"),
                        "n_children", "n_leaves", "saved_tokens", F.lit(top_digest).alias("ends_sha256"))
    return rows.unionByName(head).select(*[F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) for c in columns])
