"""Prefix trie of conversations as a z-fast trie (operator 12).

Every conversation is a sequence of turns; a prefix is named by its depth and 128 bits of XOR-ed hashes of (position, digest
of the turn). The trie is compacted: a node stands for an edge of depths (low, high] that no conversation leaves or ends on
before `high`. It is found by its handle, the prefix at the two-fattest depth of its edge (the one with most trailing zero
bits). Conversations are inserted in batches, each with three plans and no loop over nodes:

1. locate: fat binary search. The search interval of a conversation shrinks by a join with the handles until the deepest node
   on its path is known, bit_length(longest) joins at most; one more join looks up the child, whose edge is compared;
2. edges left in the middle are split there;
3. what hangs below is compacted among the newcomers of the batch: only their new prefixes are grouped.

Annotation: ancestors by pointer doubling; members, leaves and saved tokens are sums over ancestors, combined before the
shuffle; edges are expanded to one row per depth at last. Copies of a conversation are one class with a count, so no group
of copies meets in one task. The ids that end on a node are joined in blocks of 64 and hashed as a stream.

Null conv_id: such turns belong to no conversation and are left out. Null role or text counts as empty; null turns come
first; equal turns of one conversation follow the digest of role and text. Repeated rows are repeated turns. A conversation
is held as 40 bytes a turn by one task. No conversations give no rows, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidemark.llm.storage import stored

SHARED, GROUP, HEADS = 4, 20, 3  # rebuilding: head lengths 0 to 3, conversations to a common head
EIGHTHS = (1, 8)  # batches: classes up to these eighths of their hash range
BLOCK = 6  # bits of ids that are joined to one text
NODE = ["high", "ka", "kb"]


def n_words(text: Column) -> Column:
    w = F.split(text, r"[\x20\x09-\x0D]+")
    return F.size(w) - (F.get(w, F.lit(0)) == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")


# ---- conversations ---------------------------------------------------------------------------------------------------------
def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, own: its turns in order as (turn, digest, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    t = conversations.where("conv_id is not null").select("conv_id", F.struct("turn", digest.alias("g"), n_words(text).alias("w")).alias("t"))
    return t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, turns: up to three turns of the first conversation of its twenty, then its own further turns."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, HEADS).alias("head"))
    d = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "h": h}).join(heads, "base", "left")
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    return d.select("conv_id", F.when(F.col("head").isNull(), rest).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), rest)).alias("turns"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, size, a, b, cw: names of the prefixes of depths 1 to size, and words of the first 0 to size turns."""
    t = conversations.select("conv_id", F.posexplode_outer("turns").alias("at", "t"))
    run = W.partitionBy("conv_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    t = t.select("conv_id", F.when(F.col("t").isNotNull(), F.struct("at", F.bit_xor(F.xxhash64("at", "t.g")).over(run).alias("a"),
                 F.bit_xor(F.xxhash64(F.lit("second"), "t.g", "at")).over(run).alias("b"), F.sum(F.col("t.w").cast("long")).over(run).alias("cw"))).alias("p"))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return g.select("conv_id", F.size("p").alias("size"), F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.concat(F.array(F.lit(0).cast("long")), "p.cw").alias("cw"))


def classes(rows: DataFrame) -> DataFrame:
    """One row for each different conversation: conv_id (smallest), members, size, a, b, cw."""
    end = lambda x: F.coalesce(F.get(x, F.col("size") - 1), F.lit(0).cast("long"))
    one = rows.groupBy("size", end("a").alias("ka"), end("b").alias("kb")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("members"))
    return rows.join(one.select("conv_id", "members", "ka", "kb"), "conv_id")


# ---- z-fast trie -------------------------------------------------------------------------------------------------------------
def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] with most trailing zero bits."""
    k = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, k), k)


def node(low: Column, high: Column, a: Column, b: Column, cw: Column, rep: str) -> list[Column]:
    """Columns of a node from the arrays of a conversation through it; depth d is at position d of `a` and `b`."""
    cut = lambda x: F.slice(x, low + 1, high - low)
    at = lambda x, d: F.when(d > 0, F.get(x, d - 1)).otherwise(0)
    f = two_fattest(low, high)
    return [F.col(rep).alias("rep"), low.alias("low"), high.alias("high"), at(a, high).alias("ka"), at(b, high).alias("kb"), at(a, low).alias("pa"), at(b, low).alias("pb"),
            f.alias("f"), at(a, f).alias("fa"), at(b, f).alias("fb"), cut(a).alias("ea"), cut(b).alias("eb"), F.slice(cw, low + 1, high - low + 1).alias("ecw")]


def locate(x: DataFrame, trie: DataFrame, longest: int) -> DataFrame:
    """`x` with p, the depth up to which the trie holds a conversation, and the node (xlow, xhigh, xa, xb) whose edge it
    leaves there; no node if it leaves at the end of one."""
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("xlow", "int"), ("xhigh", "int"), ("xa", "long"), ("xb", "long"), ("p", "int"))]
    s = x.select("conv_id", "size", "a", "b", "cw", F.lit(0).alias("lo"), F.col("size").alias("hi"), *blank)
    same = lambda d, ka, kb: (F.get("a", F.col(d) - 1) == F.col(ka)) & (F.get("b", F.col(d) - 1) == F.col(kb))
    common = F.expr("tlow + size(filter(sequence(1, least(thigh, size) - tlow), i -> a[tlow + i - 1] = tea[i - 1] and b[tlow + i - 1] = teb[i - 1]))").cast("int")
    handles = trie.select(F.col("f").alias("tf"), F.col("fa").alias("tfa"), F.col("fb").alias("tfb"), F.col("low").alias("tlow"), F.col("high").alias("thigh"),
                          F.col("ka").alias("tka"), F.col("kb").alias("tkb"), F.col("ea").alias("tea"), F.col("eb").alias("teb"))
    keep = ["conv_id", "size", "a", "b", "cw", "lo", "hi", "xlow", "xhigh", "xa", "xb", "p"]

    def leave(s: DataFrame, cond: Column, then: dict[str, Column]) -> DataFrame:
        edge = {"xlow": F.col("tlow"), "xhigh": F.col("thigh"), "xa": F.col("tka"), "xb": F.col("tkb"), "p": common}
        return s.select(*[(F.when(cond, edge[c]).otherwise(F.col(c)) if c in edge else then.get(c, F.col(c))).alias(c) for c in keep])

    for _ in range(longest.bit_length()):
        open_ = F.col("p").isNull() & (F.col("lo") < F.col("hi"))
        s = s.withColumn("at", F.when(open_, two_fattest(F.col("lo"), F.col("hi"))))
        s = s.withColumns({"la": F.get("a", F.col("at") - 1), "lb": F.get("b", F.col("at") - 1)})
        s = s.join(handles, (s["at"] == handles["tf"]) & (s["la"] == handles["tfa"]) & (s["lb"] == handles["tfb"]), "left")
        hit, whole = F.col("tf").isNotNull(), (F.col("thigh") <= F.col("size")) & same("thigh", "tka", "tkb")
        s = leave(s, open_ & hit & ~whole, {"lo": F.when(open_ & hit & whole, F.col("thigh")).otherwise(F.col("lo")),
                                            "hi": F.when(open_ & ~hit, F.col("at") - 1).otherwise(F.col("hi"))})
    # the deepest whole node is known; its child may hold some more
    children = handles.select(*[c for c in handles.columns if c[:2] != "tf"], (F.col("tlow") + 1).alias("tn"), F.col("tea")[0].alias("tna"), F.col("teb")[0].alias("tnb"))
    open_ = F.col("p").isNull() & (F.col("lo") < F.col("size"))
    s = s.withColumn("at", F.when(open_, F.col("lo") + 1)).withColumns({"la": F.get("a", F.col("lo")), "lb": F.get("b", F.col("lo"))})
    s = s.join(children, (s["at"] == children["tn"]) & (s["la"] == children["tna"]) & (s["lb"] == children["tnb"]), "left")
    s = leave(s, open_ & F.col("tn").isNotNull(), {})
    return s.withColumn("p", F.coalesce("p", "lo")).drop("lo", "hi")


def split(trie: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes of the trie, their edges cut where conversations leave them."""
    cuts = found.where("p > xlow and p < xhigh").groupBy(F.col("xhigh").alias("high"), F.col("xa").alias("ka"), F.col("xb").alias("kb")).agg(F.sort_array(F.collect_set("p")).alias("ps"))
    d = trie.join(cuts, NODE, "left").withColumn("ends", F.when(F.col("ps").isNull(), F.array("low", "high")).otherwise(F.concat(F.array("low"), "ps", F.array("high"))))
    d = d.select("*", F.posexplode(F.expr("slice(ends, 2, size(ends) - 1)")).alias("i", "to")).withColumn("from", F.get("ends", "i"))
    at = lambda x, depth, root: F.when(depth > F.col("low"), F.get(x, depth - F.col("low") - 1)).otherwise(F.col(root))
    f = two_fattest(F.col("from"), F.col("to"))
    cut = lambda x, more: F.slice(x, F.col("from") - F.col("low") + 1, F.col("to") - F.col("from") + more)
    return d.select("rep", F.col("from").alias("low"), F.col("to").alias("high"), at("ea", F.col("to"), "pa").alias("ka"), at("eb", F.col("to"), "pb").alias("kb"),
                    at("ea", F.col("from"), "pa").alias("pa"), at("eb", F.col("from"), "pb").alias("pb"), f.alias("f"), at("ea", f, "pa").alias("fa"), at("eb", f, "pb").alias("fb"),
                    cut("ea", 0).alias("ea"), cut("eb", 0).alias("eb"), cut("ecw", 1).alias("ecw"))


def grown(found: DataFrame) -> DataFrame:
    """Nodes below the points where located conversations leave the trie."""
    new = found.where("p < size")
    steps = new.select("conv_id", "p", "size", F.explode(F.sequence(F.col("p") + 1, F.col("size"))).alias("d"), "a", "b")
    steps = steps.select("conv_id", "p", "d", F.get("a", F.col("d") - 1).alias("ka"), F.get("b", F.col("d") - 1).alias("kb"), F.get("a", "d").alias("na"), F.get("b", "d").alias("nb"))
    ends = lambda c: F.min(c) != F.max(c)
    stops = steps.groupBy("d", "ka", "kb").agg(F.min("conv_id").alias("rep"), (F.max(F.col("na").isNull()) | F.coalesce(ends("na"), F.lit(False)) | F.coalesce(ends("nb"), F.lit(False))).alias("stop")).where("stop").drop("stop")
    on_path = steps.select("conv_id", "p", "d", "ka", "kb").join(stops, ["d", "ka", "kb"])
    chain = on_path.withColumn("low", F.coalesce(F.lag("d").over(W.partitionBy("conv_id").orderBy("d")), F.col("p"))).where("conv_id = rep").select("conv_id", "low", F.col("d").alias("high"))
    return chain.join(new.select("conv_id", "a", "b", "cw"), "conv_id").select(*node(F.col("low"), F.col("high"), F.col("a"), F.col("b"), F.col("cw"), "conv_id"))


def build(seqs: DataFrame, eighths: tuple[int, ...] = EIGHTHS) -> DataFrame:
    """The compacted trie of the classes `seqs` (stored): one row per node but the root."""
    longest = seqs.agg(F.max("size")).first()[0] or 0
    share, trie, done = F.pmod(F.xxhash64("conv_id"), F.lit(8)), None, 0
    for upto in eighths:
        x = seqs.where((F.col("size") > 0) & (share >= done) & (share < upto))
        if trie is None:
            blank = [F.lit(None).cast(t).alias(c) for c, t in (("xlow", "int"), ("xhigh", "int"), ("xa", "long"), ("xb", "long"))]
            trie = stored(grown(x.select("conv_id", "size", "a", "b", "cw", *blank, F.lit(0).alias("p"))), "trie")
        else:
            found = stored(locate(x, trie, longest), "located")
            trie = stored(split(trie, found).unionByName(grown(found)), "trie")
        done = upto
    return trie


# ---- annotation ----------------------------------------------------------------------------------------------------------------
def ancestors(trie: DataFrame) -> DataFrame:
    """`trie` with `up`: the nodes above each node, the root (0, 0, 0) last; pointers double until all have reached it."""
    above = F.struct(F.col("low").alias("high"), F.col("pa").alias("ka"), F.col("pb").alias("kb"))
    d = stored(trie.select(*NODE, F.array(above).alias("up")), "up")
    while d.where("element_at(up, -1).high > 0").limit(1).count():
        u = d.select(F.struct(*NODE).alias("top"), F.col("up").alias("further"))
        far = d.where("element_at(up, -1).high > 0").withColumn("top", F.element_at("up", -1)).join(u, "top").select(*NODE, F.concat("up", "further").alias("up"))
        d = stored(far.unionByName(d.where("element_at(up, -1).high = 0")), "up")
    return trie.join(d, NODE)


def ends_digest(rows: DataFrame) -> DataFrame:
    """high, ka, kb, ends_sha256: SHA-256 of the ascending ids of conversations that end on a node, comma-joined."""
    end = lambda x: F.coalesce(F.get(x, F.col("size") - 1), F.lit(0).cast("long"))
    ids = rows.select(F.col("size").alias("high"), end("a").alias("ka"), end("b").alias("kb"), "conv_id")
    blocks = ids.groupBy(*NODE, F.call_function("shiftright", F.col("conv_id"), F.lit(BLOCK)).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    schema = "high int, ka long, kb long, ends_sha256 string"

    def run(batches):
        key, sha, out = None, None, []
        for b in batches:
            for *k, ids in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=[*NODE, "ends_sha256"])
                out = []
        if key is not None:
            out.append((*key, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=[*NODE, "ends_sha256"])

    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids").mapInArrow(run, schema)


def annotate(trie: DataFrame, seqs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per prefix: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    nodes = ancestors(trie)
    zero = F.lit(0).cast("long")
    kids = trie.groupBy(F.col("low").alias("high"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count(F.lit(1)).alias("kids"))
    ends = seqs.select(F.col("size").alias("high"), "ka", "kb", F.col("conv_id").alias("least"), "members")
    empty = F.array().cast("array<struct<high:int,ka:bigint,kb:bigint>>")
    root = seqs.limit(1).select(F.lit(None).cast("long").alias("rep"), F.lit(-1).alias("low"), F.lit(0).alias("high"), zero.alias("ka"), zero.alias("kb"), zero.alias("pa"), zero.alias("pb"),
                                F.array(zero, zero).alias("ecw"), empty.alias("up"))
    nodes = nodes.select(*root.columns).unionByName(root).join(ends, NODE, "left").join(kids, NODE, "left").withColumn("kids", F.coalesce("kids", zero))
    nodes = stored(nodes, "nodes")
    # members, smallest member and leaves: every end counts for itself and for all above
    leaf = F.when(F.col("kids") == 0, 1).otherwise(0).cast("long")
    reach = nodes.where("members is not null").select(F.explode(F.concat(F.array(F.struct(*NODE)), "up")).alias("k"), "members", "least", leaf.alias("leaf"))
    sums = reach.groupBy("k.high", "k.ka", "k.kb").agg(F.sum("members").alias("n_convs"), F.min("least").alias("conv_id"), F.sum("leaf").alias("n_leaves"))
    full = stored(nodes.drop("members", "least").join(sums, NODE).withColumn("own", (F.col("n_convs") - 1) * (F.element_at("ecw", -1) - F.get("ecw", F.lit(0)))), "full")
    below = full.select(F.explode("up").alias("k"), "own").groupBy("k.high", "k.ka", "k.kb").agg(F.sum("own").alias("below"))
    heads = full.select(F.col("high").alias("low"), F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv_id").alias("above"))
    d = full.join(below, NODE, "left").join(heads, ["low", "pa", "pb"], "left").join(ends_digest(rows), NODE, "left")
    d = d.select("*", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("depth"))
    last = F.col("depth") == F.col("high")
    words = F.element_at("ecw", -1) - F.get("ecw", F.col("depth") - F.col("low") - 1)
    return d.select("conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") > F.col("low") + 1, F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
                    "n_convs", F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
                    ((F.col("n_convs") - 1) * words + F.coalesce("below", zero)).alias("saved_tokens"),
                    F.when(last, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, eighths: tuple[int, ...] = EIGHTHS) -> DataFrame:
    """The annotated trie of the rebuilt conversations."""
    own = stored(turns_of(conversations), "turns")
    rows = stored(prefixes(rebuilt(own)), "prefixes")
    seqs = stored(classes(rows), "classes")
    return annotate(build(seqs, eighths), seqs, rows)
