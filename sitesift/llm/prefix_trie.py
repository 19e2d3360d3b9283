"""Conversation prefix trie by bursting containers.

Every turn becomes a unit of 20 bytes: 16 of the SHA-256 of role and text, 4 of its number
of words, so texts are read once and never shuffled. A conversation is cut into blocks of
64 units. Equal blocks below the same node are one suffix with a count. The suffixes below
a trie head form its container: a container of too many suffixes bursts by the next unit
into nodes with containers of their own; the others are dealt to shards by head, sorted,
and swept into nodes. Conversations that share all of a block with others go on to the
next block below the node that they share; where a conversation is alone, its further
turns are a chain and need no container. Totals of subtrees are added up from the deepest
blocks to the first.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.common import stored
from sitesift.operators.ranking import row_number_within

FAMILY, HEAD_TURNS = 20, 4     # a conversation starts like the first of its family, for id hash % 4 turns
WIDTH = 64                     # turns of a block
LIMIT = 512                    # suffixes of a container that is swept in one piece
KEY, UNIT = 16, 20             # bytes of a head's key and of a turn
PIECE = 4096                   # ids joined into one piece of an id list
ROOT = bytes(KEY)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _key(*parts) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, KEY)


def units(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, unit) of every turn whose conversation has an id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.sha2(F.concat_ws(":", F.length(role), role, text).cast("binary"), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.unhex(F.concat(F.substring(digest, 1, 2 * KEY), F.lpad(F.hex(words), 8, "0"))).alias("unit"))


def _sizes(own: DataFrame) -> DataFrame:
    """From (conv, n): also h, the turns taken from the family's first conversation (at
    most h, blen of them exist), and the rebuilt length."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD_TURNS
    first = own.select(F.col("conv").alias("base"), F.col("n").alias("nb"))
    return (own.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(first, "base", "left")
            .withColumn("blen", F.least("h", F.coalesce("nb", F.lit(0))).cast("long"))
            .withColumn("len", F.col("blen") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("nb"))


def rebuilt_blocks(turns: DataFrame) -> DataFrame:
    """(conv, b, seq, goes_on, len): block b of each rebuilt conversation as joined units;
    a conversation without turns has one empty block."""
    own = stored(row_number_within(turns, ["conv"], ["turn", "unit"], per_key=_sizes), "trie-turns")
    convs = own.where("rn = 1").select("conv", "base", "blen", "len")
    heads = (own.where(F.col("rn") < HEAD_TURNS).groupBy(F.col("conv").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("rn", "unit"))).alias("first")))
    lent = (convs.where("blen > 0").join(heads, "base")
            .select("conv", "len", F.explode(F.expr("slice(first, 1, int(blen))")).alias("t"))
            .select("conv", (F.col("t.rn") - 1).alias("pos"), "t.unit", "len"))
    kept = own.where("rn > h").select("conv", F.expr("blen + rn - h - 1").alias("pos"), "unit", "len")
    rows = lent.unionByName(kept).withColumn("b", F.expr(f"pos div {WIDTH}"))
    seq = F.expr("unhex(array_join(transform(array_sort(collect_list(struct(pos, hex(unit) as u))), x -> x.u), ''))")
    cut = rows.groupBy("conv", "b").agg(seq.alias("seq"), F.max("len").alias("len"))      # at most 64 units each
    none = convs.where("len = 0").select("conv", F.lit(0).cast("long").alias("b"), F.unhex(F.lit("")).alias("seq"), "len")
    both = cut.unionByName(none)
    return stored(both.withColumn("goes_on", F.col("len") > (F.col("b") + 1) * WIDTH), "trie-blocks")


def _pieces(batches):
    """Sorted (k, conv) -> (k, low, ids): up to PIECE ids of a key joined by commas."""
    key, ids, out = None, [], []

    def flush():
        if ids:
            out.append((key, ids[0], ",".join(map(str, ids))))

    for b in batches:
        for k, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != key or len(ids) == PIECE:
                flush()
                key, ids = k, []
            ids.append(conv)
        if len(out) > 1000:
            yield _record(out, ["k", "low", "ids"], [pa.binary(), pa.int64(), pa.string()])
            out = []
    flush()
    if out:
        yield _record(out, ["k", "low", "ids"], [pa.binary(), pa.int64(), pa.string()])


def _hashes(batches):
    """Pieces sorted by (k, low) -> (k, sha): the digest of each key's whole list."""
    key, digest, out = None, None, []
    for b in batches:
        for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if len(out) > 1000:
            yield _record(out, ["k", "sha"], [pa.binary(), pa.string()])
            out = []
    if key is not None:
        out.append((key, digest.hexdigest()))
        yield _record(out, ["k", "sha"], [pa.binary(), pa.string()])


def _record(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def id_list_hashes(ended: DataFrame) -> DataFrame:
    """(k, sha) from (k, conv): SHA-256 of each key's ids in ascending order. The ids of a
    large key are sorted and joined by many tasks; only the digest itself runs along them."""
    pieces = (ended.select("k", "conv").repartitionByRange("k", "conv").sortWithinPartitions("k", "conv")
              .mapInArrow(_pieces, "k binary, low long, ids string"))
    return (pieces.repartition("k").sortWithinPartitions("k", "low").mapInArrow(_hashes, "k binary, sha string"))


class _Sweep:
    """Sorted suffixes of one container -> nodes. A node is a list [parent index, words,
    convs, smallest conv, children, leaves, saved, sha]; number 0 stands for the head."""

    def __init__(self, head: bytes, path: bytes, base: int, depth: int):
        self.head, self.path, self.base, self.depth = head, path, base, depth
        self.nodes = [[0, 0, 0, None, 0, 0, 0, None]]
        self.open, self.last = [0], []

    def add(self, seq: bytes, n: int, low: int, goes_on: bool, ch: int, lv: int, sv: int, sha: str | None):
        here = [seq[i:i + UNIT] for i in range(self.base * UNIT, len(seq), UNIT)]
        same = 0
        while same < min(len(here), len(self.last)) and here[same] == self.last[same]:
            same += 1
        self._close(same)
        for u in here[same:]:
            self.nodes.append([self.open[-1], int.from_bytes(u[KEY:], "big"), 0, None, 0, 0, 0, None])
            self.open.append(len(self.nodes) - 1)
        self.last = here
        top = self.nodes[self.open[-1]]
        top[2] += n
        top[3] = low if top[3] is None else min(top[3], low)
        if goes_on:
            top[4], top[5], top[6] = top[4] + ch, top[5] + lv, top[6] + sv
        else:
            top[7] = sha

    def _close(self, depth: int):
        while len(self.open) > depth + 1:
            node = self.nodes[self.open.pop()]
            up = self.nodes[node[0]]
            node[5] += node[4] == 0
            node[6] += (node[2] - 1) * node[1]
            up[2], up[3] = up[2] + node[2], node[3] if up[3] is None else min(up[3], node[3])
            up[4], up[5], up[6] = up[4] + 1, up[5] + node[5], up[6] + node[6]

    def rows(self):
        """Nodes with their parent's conv (null below the head) and one row of the head's totals."""
        self._close(0)
        deep = [self.depth]
        for up, _, n, low, ch, lv, sv, sha in self.nodes[1:]:
            deep.append(deep[up] + 1)
            yield (False, self.head, None, deep[-1], low, self.nodes[up][3] if up else None, n, ch, lv, sv, sha)
        _, _, _, _, ch, lv, sv, sha = self.nodes[0]
        yield (True, self.head, self.path, self.depth, None, None, None, ch, lv, sv, sha)


SWEPT = [("is_head", "boolean", pa.bool_()), ("head", "binary", pa.binary()), ("path", "binary", pa.binary()),
         ("depth", "long", pa.int64()), ("conv_id", "long", pa.int64()), ("parent_conv_id", "long", pa.int64()),
         ("n_convs", "long", pa.int64()), ("ch", "long", pa.int64()), ("lv", "long", pa.int64()),
         ("sv", "long", pa.int64()), ("sha", "string", pa.string())]


def _sweep(start: int):
    """Sweeper of suffixes sorted by (head, seq); ``start`` turns lie before the block."""
    names, types = [n for n, _, _ in SWEPT], [t for _, _, t in SWEPT]

    def run(batches):
        cur, out = None, []
        for b in batches:
            for head, path, o, *suffix in zip(*(c.to_pylist() for c in b.columns)):
                if cur is None or cur.head != head:
                    if cur is not None:
                        out += cur.rows()
                    cur = _Sweep(head, path, o, start + o)
                    if len(out) > 20_000:
                        yield _record(out, names, types)
                        out = []
                cur.add(*suffix)
        if cur is not None:
            out += cur.rows()
            yield _record(out, names, types)

    return run


def _burst(suffixes: DataFrame, start: int, limit: int):
    """Burst containers of more than ``limit`` suffixes, turn by turn. Returns the
    containers to sweep, the nodes made and the heads' shares of totals (lists of tables)."""
    rest = ["seq", "n", "low", "goes_on", "tc", "tl", "ts", "sha"]
    cur = suffixes.select(F.col("class").alias("head"), F.col("class").alias("path"), F.lit(0).alias("o"), *rest)
    sweep, nodes, shares, o = [], [], [], 0
    while True:
        big = stored(cur.groupBy("head").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > limit).select("head"), "trie-big")
        if big.isEmpty():
            return [*sweep, cur], nodes, shares
        sweep.append(cur.join(big, "head", "left_anti").select(*cur.columns))
        hot = cur.join(big, "head", "left_semi").select(*cur.columns)
        over = F.length("seq") == o * UNIT
        shares.append(hot.where(over).select("head", "path", F.when(F.col("goes_on"), F.col("tc")).otherwise(0).alias("ch"),
                                             F.col("tl").alias("lv"), F.col("ts").alias("sv"), "sha"))
        hot = hot.where(~over).withColumn("u", F.substring("seq", o * UNIT + 1, UNIT)).withColumn("child", _key("head", "u"))
        made = stored(hot.groupBy("head", "path", "child", "u").agg(F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"))
                      .withColumn("words", F.conv(F.hex(F.substring("u", KEY + 1, UNIT - KEY)), 16, 10).cast("long"))
                      .withColumn("depth", F.lit(start + o + 1).cast("long")), "trie-nodes")
        nodes.append(made)
        nothing = [F.lit(0).cast("long").alias(c) for c in ("lv", "sv")]
        shares.append(made.select("head", "path", F.lit(1).cast("long").alias("ch"), *nothing, F.lit(None).cast("string").alias("sha")))
        shares.append(made.select(F.col("child").alias("head"), F.concat("path", "child").alias("path"),
                                  F.lit(0).cast("long").alias("ch"), nothing[0],
                                  ((F.col("n_convs") - 1) * F.col("words")).alias("sv"), F.lit(None).cast("string").alias("sha")))
        o += 1
        cur = stored(hot.select(F.col("child").alias("head"), F.concat("path", "child").alias("path"), F.lit(o).alias("o"), *rest),
                     "trie-containers")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


NODE = ["depth", "conv_id", "parent_key", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha"]


def _block_nodes(suffixes: DataFrame, start: int, limit: int):
    """Nodes of one block of turns, and the totals of its classes (the heads it began with)."""
    sweep, made, shares = _burst(suffixes, start, limit)
    swept = stored(_union(sweep).repartition("head").sortWithinPartitions("head", "seq")
                   .select("head", "path", "o", "seq", "n", "low", "goes_on", "tc", "tl", "ts", "sha")
                   .mapInArrow(_sweep(start), ", ".join(f"{n} {t}" for n, t, _ in SWEPT)), "trie-swept")
    shares.append(swept.where("is_head").select("head", "path", "ch", "lv", "sv", "sha"))
    heads = stored(_union(shares).groupBy("head", "path").agg(
        F.sum("ch").alias("ch"), F.sum("lv").alias("lv"), F.sum("sv").alias("sv"), F.max("sha").alias("sha"))
        .withColumn("lv", F.col("lv") + (F.col("ch") == 0).cast("long")), "trie-heads")
    above = F.expr(f"transform(sequence(1, length(path) div {KEY}), i -> substring(path, (i - 1) * {KEY} + 1, {KEY}))")
    totals = heads.select(F.explode(above).alias("head"), "lv", "sv").groupBy("head").agg(
        F.sum("lv").alias("n_leaves"), F.sum("sv").alias("saved_tokens"))
    totals = stored(totals.join(heads.select("head", F.col("ch").alias("n_children"), "sha", "path"), "head"), "trie-totals")
    none = F.lit(None).cast("binary")
    nodes = [swept.where("not is_head").select(
        "depth", "conv_id", F.when(F.col("parent_conv_id").isNull(), F.col("head")).alias("parent_key"), "parent_conv_id", "n_convs",
        F.col("ch").alias("n_children"), F.col("lv").alias("n_leaves"), F.col("sv").alias("saved_tokens"), "sha")]
    known = []
    if made:
        burst = _union(made).withColumnRenamed("head", "parent_key").withColumnRenamed("child", "head").drop("path")
        nodes.append(burst.join(totals, "head").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*NODE))
        known = [burst.select(F.col("head").alias("parent_key"), F.col("conv_id").alias("low"))]
    classes = totals.where(F.length("path") == KEY).select(F.col("head").alias("class"), "n_children", "n_leaves", "saved_tokens", "sha")
    return [n.withColumn("parent_key", F.coalesce("parent_key", none)) for n in nodes], known, classes


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's turns are ordered by turn (null first; turns with equal numbers by the
    digest of role and text). Null roles and texts are empty; rows without a conversation id
    are left out; an empty table has no conversations and gives no rows; other columns are
    ignored. No task holds more than ``limit`` suffixes of 64 turns at once.
    """
    # written before they are ranked: the range partitioning reads its input twice
    turns = stored(units(conversations, id_col, turn_col, role_col, text_col), "trie-units")
    blocks = rebuilt_blocks(turns)
    if blocks.isEmpty():
        schema = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
                  "saved_tokens long, ends_sha256 string")
        return conversations.sparkSession.createDataFrame([], schema)
    # down: equal blocks below the same class are one suffix
    rounds, alone, r = [], [], 0
    rows = blocks.where("b = 0").withColumn("class", F.lit(ROOT))
    while True:
        rows = rows.withColumn("k", _key("class", "seq"))
        suffixes = stored(rows.groupBy("class", "seq", "k", "goes_on").agg(
            F.count(F.lit(1)).alias("n"), F.min("conv").alias("low")), "trie-suffixes")
        hashes = stored(id_list_hashes(rows.where("not goes_on")), "trie-ends")
        rounds.append((suffixes, hashes))
        alone.append(suffixes.where("goes_on and n = 1").select(F.col("low").alias("conv"), F.lit(r + 1).alias("since"), "k"))
        shared = suffixes.where("goes_on and n > 1").select("k")
        if shared.isEmpty():
            break
        active = rows.where("goes_on").join(shared, "k", "left_semi").select("conv", F.col("k").alias("class"))
        r += 1
        rows = stored(blocks.where(F.col("b") == r).join(active, "conv").select(*blocks.columns, "class"), "trie-active")
    # up: totals of the next block's classes belong to the nodes at which this block's suffixes end
    nodes, known, classes = [], [], None
    for r in range(len(rounds) - 1, -1, -1):
        suffixes, hashes = rounds[r]
        s = suffixes.join(hashes.withColumn("goes_on", F.lit(False)), ["k", "goes_on"], "left")
        one = F.when(F.col("goes_on"), 1).otherwise(0).cast("long")
        if classes is None:
            s = s.select("*", one.alias("tc"), one.alias("tl"), F.lit(0).cast("long").alias("ts"))
        else:
            below = classes.select(F.col("class").alias("k"), F.col("n_children").alias("tc"), F.col("n_leaves").alias("tl"),
                                   F.col("saved_tokens").alias("ts"), F.lit(True).alias("goes_on"))
            s = s.join(below, ["k", "goes_on"], "left").withColumns({
                "tc": F.coalesce("tc", one), "tl": F.coalesce("tl", one), "ts": F.coalesce("ts", F.lit(0).cast("long"))})
        made, heads, classes = _block_nodes(stored(s, "trie-weighted"), r * WIDTH, limit)
        nodes += made
        known += heads
        # a block's last node is the head of what goes on below it
        known.append(suffixes.groupBy("k").agg(F.min("low").alias("low"), F.max("goes_on").alias("on")).where("on")
                     .select(F.col("k").alias("parent_key"), "low"))
    n, low = blocks.where("b = 0").agg(F.count(F.lit(1)), F.min("conv")).first()
    root = classes.where(F.col("class") == F.lit(ROOT)).select(
        F.lit(0).cast("long").alias("depth"), F.lit(low).cast("long").alias("conv_id"), F.lit(None).cast("binary").alias("parent_key"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n).cast("long").alias("n_convs"),
        "n_children", "n_leaves", "saved_tokens", "sha")
    known.append(root.select(F.lit(ROOT).alias("parent_key"), F.col("conv_id").alias("low")))
    nodes.append(_chains(blocks, stored(_union(alone), "trie-alone")))
    known = stored(_union(known), "trie-known")
    found = stored(_union(nodes), "trie-found")
    below = found.where("parent_key is not null").drop("parent_conv_id").join(known, "parent_key", "left").withColumnRenamed(
        "low", "parent_conv_id")
    every = _union([root, found.where("parent_key is null"), below.select(*NODE)])
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("sha", F.lit(NO_ENDS)).alias("ends_sha256"))


def _chains(blocks: DataFrame, alone: DataFrame) -> DataFrame:
    """Nodes of the turns behind the block from which a conversation is alone."""
    rows = blocks.join(alone, "conv").where("b >= since")
    rows = rows.withColumn("i", F.explode(F.expr(f"sequence(1, length(seq) div {UNIT})")))
    depth, last = F.col("b") * WIDTH + F.col("i"), F.col("b") * WIDTH + F.col("i") == F.col("len")
    begins = (F.col("b") == F.col("since")) & (F.col("i") == 1)
    return rows.select(
        depth.alias("depth"), F.col("conv").alias("conv_id"), F.when(begins, F.col("k")).alias("parent_key"),
        F.when(~begins, F.col("conv")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).alias("sha"))


def oracle_sql() -> str:
    crc = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1),
               lambda i: CAST(ascii(s[i]) AS BIGINT))), lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0],
               lambda z, i: xor(z >> 1, (z & 1) * 3988292384))), CAST(4294967295 AS BIGINT))"""
    return f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
           WHERE conv_id IS NOT NULL),
u AS (SELECT c, turn, substr(sha256(CAST(length(r) AS VARCHAR) || ':' || r || ':' || x), 1, 32) AS u,
             len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w FROM t),
k AS (SELECT c, u, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, u) AS rn FROM u),
cs AS (SELECT c, {crc} % 4 AS h FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t)),
parts AS (SELECT cs.c, 0 AS g, k.rn, k.u FROM cs JOIN k ON k.c = cs.c - cs.c % 20 AND k.rn <= cs.h
          UNION ALL SELECT cs.c, 1, k.rn, k.u FROM cs JOIN k ON k.c = cs.c AND k.rn > cs.h),
q AS (SELECT cs.c, coalesce(string_agg(u, '' ORDER BY g, rn), '') AS s FROM cs LEFT JOIN parts USING (c) GROUP BY cs.c),
m AS (SELECT c, s, unnest(range(0, length(s) // 32 + 1)) AS d FROM q),
n AS (SELECT substr(s, 1, 32 * d) AS p, d, count(*) AS n, min(c) AS low,
             string_agg(CASE WHEN length(s) = 32 * d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM m GROUP BY ALL),
ch AS (SELECT substr(p, 1, 32 * (d - 1)) AS p, count(*) AS k FROM n WHERE d > 0 GROUP BY 1),
wd AS (SELECT u, max(w) AS w FROM u GROUP BY u),
f AS (SELECT n.*, coalesce(ch.k, 0) AS k, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * wd.w END AS own
      FROM n LEFT JOIN ch USING (p) LEFT JOIN wd ON d > 0 AND wd.u = substr(n.p, 32 * (n.d - 1) + 1, 32)),
a AS (SELECT substr(p, 1, 32 * dd) AS p, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum(own) AS saved
      FROM (SELECT *, unnest(range(0, d + 1)) AS dd FROM f) GROUP BY 1)
SELECT f.low AS conv_id, CAST(f.d AS BIGINT) AS depth, up.low AS parent_conv_id, f.n AS n_convs, CAST(f.k AS BIGINT) AS n_children,
       CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN a USING (p) LEFT JOIN f up ON f.d > 0 AND up.p = substr(f.p, 1, 32 * (f.d - 1))
"""
