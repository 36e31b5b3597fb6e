"""A trie of conversation prefixes, built as a z-fast trie in batches.

1. A turn becomes a digest of (role, text) and a conversation a chain of prefix digests, so a prefix of any depth is
   named by one value. Conversations of one content collapse to one sequence by an aggregate.
2. The compacted trie is a table of nodes. A node's edge covers the depths (top, depth]; its handle is the prefix at
   the edge's two-fattest depth, the number with the most trailing zero bits.
3. A batch of sequences finds its exit nodes by fat binary search: each round looks up the two-fattest depth of every
   sequence's remaining interval among the handles (one equi-join), and about log2(turns) rounds leave the deepest
   node whose extent the sequence starts with. One more look-up, by the first prefix of an edge, gives the exit edge.
4. A batch is inserted at once: the prefixes behind the exits are counted, those that branch or end become nodes, and
   edges in which sequences leave are cut.
5. Sums over subtrees run by pointer doubling over the compacted nodes, then every edge is expanded to its depths.

Batches grow, so most sequences meet a trie that holds their common beginnings and only bring their own ends. A
sequence's digests (16 bytes a turn) are held together by one task; texts are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowarden.session import materialise

ROOT = hashlib.md5(b"").digest()
SHARED_WITH = 100  # conversations of one hundred share the beginning of its first
MOST_SHARED = 6
BATCHES = (1 / 16, 1 / 4)  # shares of the sequences in all batches but the last
NO_IDS = hashlib.sha256(b"").hexdigest()
LISTED_IDS = 4096  # of one node: more are hashed as a stream of blocks
BLOCK_IDS = 1024
NODE = "extent binary, parent binary, top int, depth int, edge array<binary>, before array<long>, after long"


# ---- sequences of turns --------------------------------------------------------------------------------
def turn_lists(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: the turns of each conversation as (digest, code points), in order.

    The order is by turn (null first), then role, then text. A null role or text is empty. Rows without a conv_id
    belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.md5(F.concat(F.md5("role"), F.md5("text"))))
    placed = named.select("conv_id", F.row_number().over(order).alias("at"), digest.alias("digest"), F.char_length("text").cast("long").alias("chars"))
    listed = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "digest", "chars"))).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``(conv_id, turns)`` with the first h turns of the hundred's first conversation in place of a conversation's own.

    h is the crc32 of the id, modulo ``MOST_SHARED``. A first conversation that is absent gives no turn.
    """
    own = materialise(turn_lists(turns), "turn-lists")
    first = own.where(F.col("conv_id") % SHARED_WITH == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("shared"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int")
    keyed = own.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARED_WITH).alias("base"))
    begins = F.slice(F.coalesce("shared", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    ends = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return keyed.join(first, "base", "left").select("conv_id", F.concat(begins, ends).alias("turns"))


def prefixes(turns: str) -> Column:
    """Digest and code points of every prefix, the empty one first; a prefix has the same digest in every conversation."""

    @F.arrow_udf("struct<path:array<binary>,chars:array<long>>")
    def compute(rows: pa.Array) -> pa.Array:
        paths, sizes = [], []
        for row in rows:
            path, size = [ROOT], [0]
            for turn in row.as_py() or ():
                path.append(hashlib.md5(path[-1] + turn["digest"]).digest())
                size.append(size[-1] + turn["chars"])
            paths.append(path)
            sizes.append(size)
        return pa.StructArray.from_arrays([pa.array(paths, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64()))], ["path", "chars"])

    return compute(turns)


def sequences(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different sequences ``(seq, path, chars, ...)`` with digest and code points of each prefix, and all ``(conv_id, end)``.

    A sequence is named by its digest and represented by its smallest conversation.
    """
    chained = lists.select("conv_id", prefixes("turns").alias("p"))
    chained = materialise(chained.select("conv_id", "p.path", "p.chars", F.element_at("p.path", -1).alias("end")), "chained")
    members = chained.select("conv_id", "end")
    counted = members.groupBy("end").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    distinct = chained.drop("end").join(counted, "conv_id").select(
        F.col("end").alias("seq"), "path", "chars", (F.size("path") - 1).alias("length"), F.col("conv_id").alias("low"), "n"
    )
    return materialise(distinct, "sequences"), members


# ---- the trie ------------------------------------------------------------------------------------------
def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the largest power of two divides."""
    bit = F.length(F.bin(low.bitwiseXOR(high))) - 1
    step = F.pow(F.lit(2), bit).cast("int")
    return high - high % step


def _handle() -> Column:
    """A node's prefix at the two-fattest depth of its edge; the root's is the empty one."""
    return F.coalesce(F.get("edge", two_fattest(F.col("top"), F.col("depth")) - F.col("top") - 1), F.col("extent"))


def locate(batch: DataFrame, nodes: DataFrame) -> DataFrame:
    """``batch`` (seq, path, length) with the node it leaves the trie at: ``low`` is the depth of the deepest node whose
    extent it starts with, ``met`` how far it goes on into the edge ``exit`` (null, and ``met`` = ``low``, where none begins so).
    """
    handles = nodes.select(_handle().alias("handle"), F.col("extent").alias("found"), F.col("depth").alias("deep"), F.col("top").alias("above"))
    pending = batch.select("seq", "path", "length", F.lit(0).alias("at"), F.col("length").alias("high"))
    settled = None
    while True:
        done = pending.where(F.col("at") >= F.col("high")).select("seq", "path", "length", "at")
        settled = done if settled is None else settled.unionByName(done)
        open_rows = pending.where(F.col("at") < F.col("high"))
        if open_rows.isEmpty():
            break
        asked = open_rows.withColumn("fat", two_fattest(F.col("at"), F.col("high"))).withColumn("handle", F.element_at("path", F.col("fat") + 1))
        met = asked.join(handles, "handle", "left")
        whole = (F.col("deep") <= F.col("length")) & (F.get("path", F.col("deep")) == F.col("found"))
        # a handle that fits, of an extent that does not: the sequence leaves in this node's edge, below its parent
        moved = met.select(
            "seq", "path", "length", F.when(whole, F.col("deep")).otherwise(F.coalesce("above", "at")).alias("at"),
            F.when(whole, F.col("high")).otherwise(F.coalesce("above", F.col("fat") - 1)).alias("high"),
        )
        pending = materialise(moved, "search")
    edges = nodes.where(F.col("depth") > 0).select(F.element_at("edge", 1).alias("__first"), F.col("extent").alias("exit"), "edge")
    left = settled.withColumn("__first", F.get("path", F.col("at") + 1))
    shared = F.aggregate(  # equal prefixes of path and edge are equal up to some depth and differ behind it
        F.zip_with("edge", F.slice("path", F.col("at") + 2, F.greatest(F.size("edge"), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False))),
        F.lit(0), lambda n, same: n + same.cast("int"),
    )
    found = left.join(edges, "__first", "left")
    return found.select("seq", "path", "length", F.col("at").alias("low"), "exit", (F.col("at") + F.coalesce(shared, F.lit(0))).alias("met"))


def insert(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """The node table with all sequences of ``batch`` (seq, path, chars, length) in it."""
    placed = materialise(locate(batch, nodes), "located")
    # prefixes behind the exits: those that branch or end become nodes
    steps = F.explode(F.sequence(F.col("met") + 1, F.col("length"))).alias("d")
    tails = placed.where(F.col("met") < F.col("length")).select("seq", "path", "length", "met", steps)
    tails = materialise(
        tails.select("seq", "d", "met", F.get("path", F.col("d")).alias("here"), F.get("path", F.col("d") + 1).alias("next")), "tails"
    )
    counted = tails.groupBy("here").agg(
        F.min("seq").alias("one"), F.min("next").alias("a"), F.max("next").alias("b"), F.max(F.col("next").isNull()).alias("ends")
    )
    kept = counted.where(F.col("ends") | (F.col("a") != F.col("b"))).select("here", "one")
    own = tails.join(kept, "here").select("seq", "d", "met", "one")
    above = F.coalesce(F.lag("d").over(Window.partitionBy("seq").orderBy("d")), F.col("met"))
    made = own.withColumn("top", above).where(F.col("seq") == F.col("one")).select("seq", "top", F.col("d").alias("depth"))
    built = made.join(batch.select("seq", "path", "chars"), "seq")
    new = built.select(
        F.get("path", F.col("depth")).alias("extent"), F.get("path", F.col("top")).alias("parent"), "top", "depth",
        F.slice("path", F.col("top") + 2, F.col("depth") - F.col("top")).alias("edge"),
        F.slice("chars", F.col("top") + 1, F.col("depth") - F.col("top")).alias("before"), F.get("chars", F.col("depth")).alias("after"),
    )
    # edges in which a sequence leaves or ends are cut there
    cuts = placed.where(F.col("exit").isNotNull()).groupBy(F.col("exit").alias("extent"), F.col("met").alias("cut")).count()
    cuts = cuts.groupBy("extent").agg(F.collect_list("cut").alias("cuts"))
    joined = nodes.join(cuts, "extent", "left")
    inside = F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda c: (c > F.col("top")) & (c < F.col("depth")))
    bounds = F.array_sort(F.array_distinct(F.concat(F.array("top", "depth"), inside)))
    parts = joined.select(*nodes.columns, bounds.alias("bounds"))
    parts = parts.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.size("bounds") - 1, F.lit(1)))).alias("k"))
    low, high = F.element_at("bounds", F.col("k")), F.coalesce(F.get("bounds", F.col("k")), F.col("depth"))
    old = parts.select(
        F.when(high == F.col("depth"), F.col("extent")).otherwise(F.get("edge", high - F.col("top") - 1)).alias("extent"),
        F.when(low == F.col("top"), F.col("parent")).otherwise(F.get("edge", low - F.col("top") - 1)).alias("parent"),
        low.alias("top"), high.alias("depth"),
        F.slice("edge", low - F.col("top") + 1, high - low).alias("edge"), F.slice("before", low - F.col("top") + 1, high - low).alias("before"),
        F.coalesce(F.get("before", high - F.col("top")), F.col("after")).alias("after"),
    )
    return materialise(old.unionByName(new), "nodes")


def build(seqs: DataFrame) -> DataFrame:
    """Compacted nodes (``NODE``) of all sequences.

    ``edge`` holds the prefixes at the depths (top, depth], ``before`` the code points in front of each of these depths,
    ``after`` those up to ``depth``.
    """
    nodes = seqs.sparkSession.createDataFrame([(ROOT, None, 0, 0, [], [], 0)], NODE)
    share = (F.xxhash64("seq").bitwiseAND(F.lit(0xFFFF)) / F.lit(65536.0)).alias("share")
    low = 0.0
    for high in (*BATCHES, 1.0):
        batch = seqs.where((share >= low) & (share < high))
        if not batch.isEmpty():
            nodes = insert(nodes, batch)
        low = high
    return nodes


# ---- sums over subtrees --------------------------------------------------------------------------------
def _subtree_sums(state: DataFrame) -> DataFrame:
    """``state`` (node, up, low and the summed columns) with every column taken over the node's whole subtree.

    Pointer doubling: after k rounds a row covers its descendants nearer than 2^k. The root's row, whose subtree is
    everything, is a plain aggregate, so no pointer leads to it.
    """
    sums = ["n", "weighted", "span", "leaves"]
    rows = materialise(state, "subtree")
    while not rows.where(F.col("up").isNotNull()).isEmpty():
        given = rows.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("node")).agg(F.min("low").alias("__low"), *[F.sum(c).alias(f"__{c}") for c in sums])
        higher = rows.where(F.col("up").isNotNull()).select(F.col("node").alias("up"), F.col("up").alias("__up"))
        grown = rows.join(given, "node", "left").join(higher, "up", "left")
        rows = materialise(
            grown.select("node", F.col("__up").alias("up"), F.least("low", "__low").alias("low"), *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in sums]), "subtree"
        )
    return rows


def ends_sha256(members: DataFrame) -> DataFrame:
    """``(end, ends_sha256)``: SHA-256 of the ascending, comma-joined ids that end at each node.

    Nodes of more than ``LISTED_IDS`` ids are hashed as a stream: ranges of ids are joined to blocks in parallel, and
    one task only feeds the blocks of a node, in order, to the hash.
    """
    counted = members.groupBy("end").agg(F.count(F.lit(1)).alias("n"))
    crowded = materialise(counted.where(F.col("n") > LISTED_IDS).select("end"), "crowded")
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    few = members if crowded.isEmpty() else members.join(crowded, "end", "left_anti")
    listed = few.groupBy("end").agg(F.sha2(F.array_join(ids, ","), 256).alias("ends_sha256"))
    if crowded.isEmpty():
        return listed

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, first, held = None, None, []

        def flush():
            return pa.RecordBatch.from_pydict({
                "end": pa.array([end], pa.binary()), "first": pa.array([first], pa.int64()), "ids": pa.array([",".join(held)], pa.string()),
            })

        for batch in batches:
            for e, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (e != end or len(held) >= BLOCK_IDS):
                    yield flush()
                    held = []
                if not held:
                    end, first = e, i
                held.append(str(i))
        if held:
            yield flush()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, state = None, None

        def done():
            return pa.RecordBatch.from_pydict({"end": pa.array([end], pa.binary()), "ends_sha256": pa.array([state.hexdigest()])})

        for batch in batches:
            for e, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is not None and e == end:
                    state.update(b",")
                else:
                    if state is not None:
                        yield done()
                    end, state = e, hashlib.sha256()
                state.update(text.encode())
        if state is not None:
            yield done()

    many = members.join(crowded, "end").select("end", "conv_id")
    ranged = many.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    joined = ranged.mapInArrow(blocks, "end binary, first long, ids string")
    streamed = joined.repartition("end").sortWithinPartitions("end", "first").mapInArrow(fold, "end binary, ends_sha256 string")
    return listed.unionByName(streamed)


def expand(nodes: DataFrame, seqs: DataFrame, members: DataFrame) -> DataFrame:
    """Every depth of every edge as a node of the plain trie, with its counts."""
    total = F.element_at("chars", -1)
    ends = seqs.select(F.col("seq").alias("extent"), "low", "n", (F.col("n") * total).alias("weighted"))
    below = nodes.where(F.col("depth") > 0).groupBy(F.col("parent").alias("extent")).agg(F.count(F.lit(1)).alias("children"))
    known = nodes.join(below, "extent", "left").join(ends, "extent", "left").select(
        *nodes.columns, "low", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("children", "n", "weighted")],
        (F.col("after") - F.coalesce(F.get("before", F.lit(0)), F.lit(0))).alias("span"),
    )
    known = materialise(known, "counted-nodes")
    inner = _subtree_sums(known.where("depth > 0").select(
        F.col("extent").alias("node"), F.when(F.col("top") > 0, F.col("parent")).alias("up"), "low", "n", "weighted", "span",
        (F.col("children") == 0).cast("long").alias("leaves"),
    )).drop("up")
    leaf = ((F.col("children") == 0) & (F.col("depth") > 0)).cast("long")
    everything = materialise(known.agg(
        F.min("low").alias("low"), F.sum("n").alias("n"), F.sum("weighted").alias("weighted"), F.sum("span").alias("span"), F.sum(leaf).alias("leaves"),
        F.sum(F.when(F.col("depth") == 0, F.col("children"))).alias("children"),
    ).where("low IS NOT NULL").select(F.lit(ROOT).alias("node"), "*"), "root")
    parents = inner.select("node", "low").unionByName(everything.select("node", "low")).select(F.col("node").alias("parent"), F.col("low").alias("parent_low"))
    full = known.where("depth > 0").select("extent", "parent", "top", "before", "children").join(inner.withColumnRenamed("node", "extent"), "extent").join(parents, "parent")
    hashes = materialise(ends_sha256(members).withColumnRenamed("end", "extent"), "hashes")
    at = full.join(hashes, "extent", "left").select("*", F.size("before").alias("long"), F.posexplode("before").alias("i", "begun"))
    last = F.col("i") == F.col("long") - 1
    behind = F.col("begun") - F.get("before", F.lit(0))  # code points of the edge in front of this depth
    depths = at.select(
        F.col("low").alias("conv_id"), (F.col("top") + F.col("i") + 1).cast("long").alias("depth"),
        F.when(F.col("i") > 0, F.col("low")).otherwise(F.col("parent_low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        # every member's turns from here on, less one copy of each turn of the subtree
        (F.col("weighted") - F.col("n") * F.col("begun") - (F.col("span") - behind)).alias("saved_tokens"),
        F.when(last & F.col("ends_sha256").isNotNull(), F.col("ends_sha256")).otherwise(NO_IDS).alias("ends_sha256"),
    )
    root = everything.join(hashes, F.col("node") == F.col("extent"), "left").select(
        F.col("low").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").cast("long").alias("n_children"), F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"),  # alone it is a leaf itself
        (F.col("weighted") - F.col("span")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
    return root.unionByName(depths)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text); an empty table gives no row."""
    seqs, members = sequences(rebuilt(turns))
    return expand(build(seqs), seqs, members)
