"""Prefix trie of rebuilt conversations by composable fingerprints.

A rebuilt conversation is the head of a base conversation followed by the rest
of its own turns. Rebuilt texts are never made. Every turn has a hash element
t, and a sequence has the fingerprint sum(t_i * B^(i - 1)) modulo the prime
2^127 - 1: a monoid, in which (length, value) pairs compose as
(l1 + l2, v1 + B^l1 * v2). The prefix products of the original conversations
are computed once, and the fingerprint of any rebuilt prefix follows from three
of them: the base's at the head's end, the own one at the cut, and the own one
at the prefix's end, shifted by at most ``HEAD`` places.

Members of equal depth and fingerprint form a node. Equality is verified, not
assumed: all members of a node must refer to the same stored turn as their last
and have the same parent fingerprint, which by induction over depth makes
whole prefixes equal; and turns of equal hashes are compared by their role and
text. Should a comparison fail, the trie is built again with another B and hash.

Prefix products and subtree sums run along sequences that may hold a third of
all rows. Rows are therefore sorted by range, scanned inside their slice, and
only the ends of the slices (two a slice) are composed on the driver.

Subtree sums: a node belongs to its smallest member, so every conversation owns
one piece of a path, hung on a node of a smaller conversation. Totals of the
pieces are summed over that tree of conversations by pointer doubling (as many
rounds as the logarithm of its depth), then along each path by a scan.

Defined cases: rows without a conversation id take no part; a null role or text
is empty; turns of equal number are ordered by the hash of role and text; repeated rows
are turns like others; a conversation without turns is a member of
the root; an empty table gives no node; extra columns are ignored. The list of
a node's ending members is hashed as a stream, in pieces of ``PIECE`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stage, text_or_empty, workers

#: Longest head taken from a base conversation; every ``FAMILY``-th conversation is a base.
HEAD, FAMILY = 8, 5
PRIME = (1 << 127) - 1
#: Bytes of ids that are hashed from one row.
PIECE = 1 << 16
ZERO = bytes(16)
ROUNDS = 64


def multiplier(seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"prefix trie {seed}".encode()).digest()[:15], "big") | 1


def element(h1: int, h2: int) -> int:
    """Hash element of a turn: 1 to PRIME - 1."""
    return 1 + (((h1 & 0xFFFFFFFFFFFFFFFF) << 64) | (h2 & 0xFFFFFFFFFFFFFFFF)) % (PRIME - 1)


def pack(values: list[int]) -> pa.Array:
    return pa.array([v.to_bytes(16, "big") for v in values], pa.binary())


def head_length(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEAD + 1)).cast("int")


def hashed_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """conv, turn, h1, h2, bytes, role, text."""
    role, text = text_or_empty(F.col("role").cast("string")), text_or_empty(F.col("text").cast("string"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    return rows.withColumns({"h1": F.xxhash64(F.lit(seed), "role", "text"), "h2": F.xxhash64(F.lit(~seed), "text", "role"), "bytes": F.octet_length("text").cast("long")})


def unlike_turns(turns: DataFrame) -> bool:
    """Do turns of equal hashes differ in role or text? Only repeated hashes are compared."""
    repeated = turns.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    both = F.struct("role", "text")
    seen = turns.join(repeated, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.min(both).alias("low"), F.max(both).alias("high"))
    return bool(seen.where("low <> high").limit(1).count())


def sliced(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows sorted by range; equal keys may span slices."""
    return workers(rows).repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)


def carried(scanned: DataFrame, values: list[str], compose) -> dict[int, tuple]:
    """{slice: (conv, total before it)} for slices that begin inside a conversation.

    ``scanned`` holds pid, conv, idx (row number in the slice's run) and the run's
    totals so far. Two runs a slice reach the driver, whatever their rows.
    """
    runs = scanned.groupBy("pid", "conv").agg(F.max(F.struct("idx", *values)).alias("end"))
    ends = runs.groupBy("pid").agg(F.min(F.struct("conv", "end")).alias("first"), F.max(F.struct("conv", "end")).alias("last")).collect()
    out: dict[int, tuple] = {}
    open_conv, total = None, None
    for r in sorted(ends, key=lambda r: r["pid"]):
        first, last = ((x["conv"], tuple(x["end"])) for x in (r["first"], r["last"]))
        if open_conv == first[0]:
            out[r["pid"]] = (open_conv, total)
        if first[0] == last[0]:
            total = compose(total, first[1]) if open_conv == first[0] else first[1]
        else:
            total = last[1]
        open_conv = last[0]
    return out


def prefix_products(turns: DataFrame, base: int) -> DataFrame:
    """conv, pos (from 1), h1, h2, bytes, v (fingerprint to pos) and u (to pos - 1) of the original turns."""
    rows = turns.select("conv", "turn", "h1", "h2", "bytes").withColumn("spread", F.monotonically_increasing_id())
    laid = sliced(rows, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2"), F.col("spread")).select("conv", "h1", "h2", "bytes")
    names = ["conv", "h1", "h2", "bytes", "pid", "idx", "v", "u"]

    def scan(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        pid, conv, idx, value, power = TaskContext.get().partitionId(), None, 0, 0, 1
        for batch in batches:
            ids, now, before = [], [], []
            for one, h1, h2 in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if one != conv:
                    conv, idx, value, power = one, 0, 0, 1
                before.append(value)
                value = (value + element(h1, h2) * power) % PRIME
                power = power * base % PRIME
                idx += 1
                ids.append(idx)
                now.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pid] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pack(now), pack(before)], names=names)

    scanned = stage(laid.mapInArrow(scan, "conv long, h1 long, h2 long, bytes long, pid int, idx long, v binary, u binary"), "trie-scan")

    def compose(a, b):  # (length, value) pairs
        return a[0] + b[0], (int.from_bytes(a[1], "big") + pow(base, a[0], PRIME) * int.from_bytes(b[1], "big")).__mod__(PRIME).to_bytes(16, "big")

    before = carried(scanned, ["v"], compose)
    shifts = {pid: (conv, n, int.from_bytes(v, "big"), pow(base, n, PRIME)) for pid, (conv, (n, v)) in before.items()}

    def shift(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            cols = {n: batch.column(k).to_pylist() for k, n in enumerate(names)}
            for k, (pid, conv) in enumerate(zip(cols["pid"], cols["conv"], strict=True)):
                if (s := shifts.get(pid)) and s[0] == conv:
                    cols["idx"][k] += s[1]
                    for c in "vu":
                        cols[c][k] = ((s[2] + s[3] * int.from_bytes(cols[c][k], "big")) % PRIME).to_bytes(16, "big")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols["idx"], pa.int64()), *batch.columns[1:4], pa.array(cols["v"], pa.binary()), pa.array(cols["u"], pa.binary())], names=["conv", "pos", "h1", "h2", "bytes", "v", "u"])

    return stage(scanned.mapInArrow(shift, "conv long, pos long, h1 long, h2 long, bytes long, v binary, u binary"), "trie-turns")


def rebuild_plans(turns: DataFrame) -> DataFrame:
    """Per conversation: its head (at most ``HEAD`` turns of the base), and the products that shift its own suffix."""
    lead = F.struct("pos", "h1", "h2", "bytes", "v")
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") <= HEAD, lead))).alias("lead"))
    bases = convs.where(F.col("conv") % FAMILY == 0).select(F.col("conv").alias("base"), F.col("lead").alias("base_lead"))
    joined = convs.join(bases, F.col("conv") - F.col("conv") % FAMILY == F.col("base"), "left").withColumn("h", head_length(F.col("conv")))
    zero = F.lit(ZERO)
    kept = joined.withColumns({"head": F.expr("CASE WHEN base_lead IS NULL THEN slice(lead, 1, 0) ELSE slice(base_lead, 1, h) END"), "cut": F.expr("least(h, n)")})
    return kept.select(
        "conv", "h", "head", F.size("head").alias("head_n"), (F.size("head") + F.col("n") - F.col("cut")).alias("length"),
        F.coalesce(F.expr("get(head, size(head) - 1).v"), zero).alias("head_v"), F.coalesce(F.expr("get(lead, int(cut) - 1).v"), zero).alias("cut_v"),
    )


def memberships(turns: DataFrame, plans: DataFrame, base: int) -> DataFrame:
    """conv, depth, fp, up (the parent's fp), h1, h2, bytes, ends: one row for each rebuilt prefix."""
    zero = F.lit(ZERO)
    last = (F.col("depth") == F.col("length")).alias("ends")
    root = plans.select("conv", F.lit(0).cast("long").alias("depth"), zero.alias("fp"), zero.alias("up"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.lit(0).cast("long").alias("bytes"), (F.col("length") == 0).alias("ends"))
    shared = plans.select("conv", "length", "head", F.posexplode("head").alias("k", "e"))
    head = shared.withColumn("depth", (F.col("k") + 1).cast("long")).select("conv", "depth", F.col("e.v").alias("fp"), F.coalesce(F.expr("get(head, k - 1).v"), zero).alias("up"), "e.h1", "e.h2", "e.bytes", last)
    own = turns.join(plans.drop("head"), "conv").where("pos > h")
    own = own.select("conv", (F.col("head_n") + F.col("pos") - F.col("h")).alias("depth"), "v", "u", "h1", "h2", "bytes", "length", (F.col("h") - F.col("head_n")).alias("back"), "head_v", "cut_v")
    inverse = pow(base, -1, PRIME)
    shifts = [pow(inverse, k, PRIME) for k in range(HEAD + 1)]

    def join(batches: Iterator[pa.RecordBatch]):
        number = lambda x: int.from_bytes(x, "big")
        for batch in batches:
            v, u, back, head_v, cut_v = (batch.column(k).to_pylist() for k in (2, 3, 8, 9, 10))
            made = [[(number(h) + (number(x) - number(c)) * shifts[b]) % PRIME for x, b, h, c in zip(col, back, head_v, cut_v, strict=True)] for col in (v, u)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pack(made[0]), pack(made[1]), *(batch.column(k) for k in (4, 5, 6, 7))], names=["conv", "depth", "fp", "up", "h1", "h2", "bytes", "length"])

    suffix = own.mapInArrow(join, "conv long, depth long, fp binary, up binary, h1 long, h2 long, bytes long, length long").select("conv", "depth", "fp", "up", "h1", "h2", "bytes", last)
    return root.unionAll(head).unionAll(suffix)


def ending_hashes(members: DataFrame) -> DataFrame:
    """depth, fp, ends_sha256 of the nodes at which conversations end."""
    ends = members.where("ends").select("depth", "fp", "conv")
    laid = sliced(ends, F.col("depth"), F.col("fp"), F.col("conv"))

    def pieces(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        pid, seq = TaskContext.get().partitionId(), 0
        key, held, size = None, [], 0

        def send():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((key[0], pa.int64()), (key[1], pa.binary()), (pid, pa.int32()), (seq, pa.int64()), (",".join(held), pa.string()))], names=["depth", "fp", "pid", "seq", "ids"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[:2] != key or size > PIECE):
                    yield send()
                    seq, held, size = seq + 1, [], 0
                key = row[:2]
                held.append(str(row[2]))
                size += len(held[-1]) + 1
        if held:
            yield send()

    cut = stage(laid.mapInArrow(pieces, "depth long, fp binary, pid int, seq long, ids string"), "trie-ends")

    def chain(batches: Iterator[pa.RecordBatch]):
        key, made = None, None
        for batch in batches:
            out = []
            for depth, fp, _, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, fp) != key:
                    if key:
                        out.append((*key, made.hexdigest()))
                    key, made = (depth, fp), hashlib.sha256(ids.encode())
                else:
                    made.update(f",{ids}".encode())
            yield lines(out)
        if key:
            yield lines([(*key, made.hexdigest())])

    def lines(out):
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.string()))], names=["depth", "fp", "ends_sha256"])

    laid = cut.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "pid", "seq")
    return laid.mapInArrow(chain, "depth long, fp binary, ends_sha256 string")


def path_totals(owned: DataFrame) -> DataFrame:
    """conv, at_conv, at_depth, leaves, saved: subtree totals of each conversation's piece of path and where it hangs."""
    top = F.col("parent_conv").isNull() | (F.col("parent_conv") != F.col("conv"))
    state = owned.groupBy("conv").agg(F.sum("leaf").alias("leaves"), F.sum("worth").alias("saved"), F.max(F.when(top, F.col("parent_conv"))).alias("at_conv"), F.max(F.when(top, F.col("depth") - 1)).alias("at_depth"))
    state = stage(state.withColumn("jump", F.col("at_conv")), "trie-paths")
    for _ in range(ROUNDS):
        if not state.where("jump IS NOT NULL").limit(1).count():
            return state
        below = state.where("jump IS NOT NULL").groupBy(F.col("jump").alias("conv")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        onward = state.select(F.col("conv").alias("jump"), F.col("jump").alias("onward"))
        moved = state.join(below, "conv", "left").join(onward, "jump", "left")
        total = lambda own, more: (F.col(own) + F.coalesce(F.col(more), F.lit(0))).alias(own)
        state = stage(moved.select("conv", total("leaves", "more_leaves"), total("saved", "more_saved"), "at_conv", "at_depth", F.col("onward").alias("jump")), "trie-paths")
    raise ValueError("a tree of conversations has no end")


def subtree_sums(owned: DataFrame) -> DataFrame:
    """conv, depth, n_leaves, saved_tokens of every node."""
    hung = path_totals(owned).where("at_conv IS NOT NULL").groupBy(F.col("at_conv").alias("conv"), F.col("at_depth").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    total = lambda own, more: (F.col(own) + F.coalesce(F.col(more), F.lit(0))).alias(own)
    values = owned.join(hung, ["conv", "depth"], "left").select("conv", "depth", total("leaf", "more_leaves"), total("worth", "more_saved"))
    names = ["conv", "depth", "pid", "idx", "leaves", "saved"]

    def scan(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        pid, conv, idx, leaves, saved = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in batches:
            out = [[], [], []]
            for one, _, leaf, worth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if one != conv:
                    conv, idx, leaves, saved = one, 0, 0, 0
                idx, leaves, saved = idx + 1, leaves + leaf, saved + worth
                for col, x in zip(out, (idx, leaves, saved), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pid] * batch.num_rows, pa.int32()), *(pa.array(x, pa.int64()) for x in out)], names=names)

    laid = sliced(values, F.col("conv"), F.col("depth").desc())
    scanned = stage(laid.mapInArrow(scan, "conv long, depth long, pid int, idx long, leaves long, saved long"), "trie-sums")
    before = carried(scanned, ["leaves", "saved"], lambda a, b: tuple(x + y for x, y in zip(a, b, strict=True)))
    # two rows a slice at most; no hint, so it is broadcast only where its size allows
    more = owned.sparkSession.createDataFrame([(pid, conv, t[1], t[2]) for pid, (conv, t) in before.items()], "pid int, conv long, l long, s long")
    joined = scanned.join(more, ["pid", "conv"], "left")
    return joined.select("conv", "depth", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved_tokens"))


def build_trie(conversations: DataFrame, seeds: range = range(8)) -> DataFrame:
    """One row for each node: conv_id (smallest member), depth, parent_conv_id and the node's figures."""
    for seed in seeds:
        made = _build(conversations, seed)
        if made is not None:
            return made
    raise ValueError("hash collisions under every seed")


def _build(conversations: DataFrame, seed: int) -> DataFrame | None:
    base = multiplier(seed)
    hashed = hashed_turns(conversations, seed)
    if unlike_turns(hashed):
        return None
    turns = prefix_products(hashed, base)
    members = stage(memberships(turns, stage(rebuild_plans(turns), "trie-plans"), base), "trie-members")
    last = F.struct("h1", "h2", "up")
    nodes = members.groupBy("depth", "fp").agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.min(last).alias("low"), F.max(last).alias("high"))
    nodes = stage(nodes.select("depth", "fp", "conv", "n_convs", "bytes", F.col("low.up").alias("up"), (F.col("low") == F.col("high")).alias("equal")), "trie-nodes")
    if nodes.where("NOT equal").limit(1).count():
        return None
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("fp")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("up"), F.col("conv").alias("parent_conv"))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    full = nodes.join(children, ["depth", "fp"], "left").join(ending_hashes(members), ["depth", "fp"], "left").join(parents, ["depth", "up"], "left")
    full = full.select("conv", "depth", "parent_conv", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("worth"), F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    full = stage(full, "trie-full")
    owned = full.select("conv", "depth", "parent_conv", (F.col("n_children") == 0).cast("long").alias("leaf"), "worth")
    sums = subtree_sums(owned)
    return full.join(sums, ["conv", "depth"]).select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
