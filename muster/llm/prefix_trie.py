"""The trie of conversations: which openings they share, how many do, and what reading each opening once would save.

A conversation is the sequence of its turns. A turn is a 128-bit fingerprint of role and text; the digest of a prefix is a hash of
the digest before it and the turn's fingerprint, so that equal digests mean equal prefixes wherever they come from.

Every task builds a z-fast trie of its conversations, a batch at a time. A node spans the depths that no branch parts (above,
depth], and is hashed at its handle: the digest at the two-fattest number of that span, the one divisible by the highest power of
two. A fat binary search over the depths of a conversation finds its exit node with a logarithmic number of lookups; there the
edge is split, or a leaf is added. Equal conversations of a batch are inserted once with their number. At the end, or when a trie
holds ``HELD`` turns, its edges are expanded: one row a prefix with its members so far. These partial rows, not the conversations,
are added up by digest, so that an opening in a third of all conversations is one row a task.

What needs the whole trie follows from ownership. A node belongs to its smallest member; the nodes of one owner are one stretch of
its path, and below that hang the stretches of other owners. So what a subtree holds is the sum over the owner's deeper nodes and
over the owners that leave the stretch there or deeper: one row for each owner met on an owner's path, at most one a turn.
Digests that hold much of these rows are met by broadcast, at most a thousand of them.

Lists of member ids are hashed as streams: ids are sorted over all tasks, joined by commas in segments there, and the segments of
one node go through one hash in order, one in memory at a time.

A conversation's fingerprints fit in a task (24 bytes a turn), its text never has to. Null roles and texts are empty. Turns
are ordered by number, null first, equal numbers by fingerprint; repeated rows are repeated turns. Rows without conversation id
belong to none and are left out. Very long texts count by their bytes. Without conversations there is no node, not even a root.
Columns other than those named don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.skew import meet
from muster.session import stored

#: Bytes of a digest, and that of the root.
SIZE = 16
ROOT = bytes(SIZE)
#: Turns a task's trie spans before it is emitted and begun anew.
HELD = 1 << 17


def fingerprint(role: Column, text: Column) -> Column:
    """Hexadecimal digits that tell turns apart; the length keeps role and text apart."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): every conversation's turns in order, as structs of fingerprint and bytes."""
    r, t = (F.coalesce(turns[c], F.lit("")) for c in (role, text))
    one = F.struct(turns[turn].isNotNull().alias("known"), turns[turn].alias("turn"),
                   F.unhex(F.substring(fingerprint(r, t), 1, 2 * SIZE)).alias("print"), F.octet_length(t).cast("bigint").alias("bytes"))
    rows = turns.filter(turns[conv].isNotNull()).select(turns[conv].cast("bigint").alias("conv_id"), one.alias("one"))
    ordered = F.transform(F.sort_array(F.collect_list("one")), lambda x: F.struct(x["print"].alias("print"), x["bytes"].alias("bytes")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def with_openings(conversations: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Conversations that begin with the first h turns of conversation ``c - c % group`` (all, if it has fewer, none, if there is
    no such conversation) in place of their own first h; h is crc32 of the id's decimal digits modulo ``most``."""
    heads = conversations.select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = conversations.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": h}).join(heads, "base", "left")
    opening = F.expr("slice(coalesce(head, slice(turns, 1, 0)), 1, h)")
    return rows.select("conv_id", F.concat(opening, F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, bytes): the digests of all prefixes, one behind the other, and the bytes of all turns."""
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for prints in batch.column(1).to_pylist():
                digest, path = ROOT, []
                for own in prints:
                    digest = hashlib.blake2b(digest + own, digest_size=SIZE).digest()
                    path.append(digest)
                found.append(b"".join(path))
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["conv_id", "path", "bytes"])

    rows = conversations.select("conv_id", F.col("turns.print").alias("prints"), F.col("turns.bytes").alias("bytes"))
    return rows.mapInArrow(chain, "conv_id bigint, path binary, bytes array<bigint>")


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    """Prefixes of depths (above, depth] of one path that no branch parts."""

    __slots__ = ("path", "sizes", "above", "depth", "parent", "children", "ends", "least")

    def __init__(self, path: bytes, sizes: list[int], above: int, depth: int, parent: Node | None):
        self.path, self.sizes, self.above, self.depth, self.parent = path, sizes, above, depth, parent
        self.children: dict[bytes, Node] = {}
        self.ends, self.least = 0, None

    def digest(self, depth: int) -> bytes:
        return self.path[SIZE * (depth - 1):SIZE * depth]

    def handle(self) -> bytes:
        return self.digest(two_fattest(self.above, self.depth))


class ZFastTrie:
    """A compacted trie over paths of digests whose nodes are found by their handles."""

    def __init__(self) -> None:
        self.root = Node(b"", [], -1, 0, None)
        self.handles: dict[bytes, Node] = {}
        self.held = 0

    def exit(self, path: bytes, length: int) -> tuple[Node, int]:
        """The node at which ``path`` leaves the trie, and the depth down to which they agree."""
        node, low, high = self.root, 0, length
        while low < high:
            fat = two_fattest(low, high)
            found = self.handles.get(path[SIZE * (fat - 1):SIZE * fat])
            if found is None:
                high = fat - 1
            elif found.depth <= length and found.digest(found.depth) == path[SIZE * (found.depth - 1):SIZE * found.depth]:
                node, low = found, found.depth
            else:
                return found, self._agreed(found, path, fat, min(found.depth, length))
        below = node.children.get(path[SIZE * node.depth:SIZE * (node.depth + 1)]) if length > node.depth else None
        if below is None:
            return node, node.depth
        return below, self._agreed(below, path, node.depth + 1, min(below.depth, length))

    @staticmethod
    def _agreed(node: Node, path: bytes, low: int, high: int) -> int:
        """The greatest depth in [low, high] at which the node's path and this one agree; they do at ``low``."""
        while low < high:
            middle = (low + high + 1) // 2
            if node.digest(middle) == path[SIZE * (middle - 1):SIZE * middle]:
                low = middle
            else:
                high = middle - 1
        return low

    def insert(self, path: bytes, sizes: list[int], n: int, least: int) -> None:
        """``n`` conversations of this path, the smallest of id ``least``."""
        length = len(path) // SIZE
        node, depth = self.exit(path, length)
        if depth < node.depth:
            node = self._split(node, depth)
        if depth < length:
            node = self._hang(Node(path, sizes, depth, length, node))
            self.held += length - depth
        node.ends += n
        node.least = least if node.least is None else min(node.least, least)

    def _hang(self, node: Node) -> Node:
        node.parent.children[node.digest(node.above + 1)] = node
        self.handles[node.handle()] = node
        return node

    def _split(self, node: Node, depth: int) -> Node:
        """The new node that ends at ``depth`` of ``node``'s edge; ``node`` hangs below it."""
        del self.handles[node.handle()]
        upper = self._hang(Node(node.path, node.sizes, node.above, depth, node.parent))
        node.above, node.parent = depth, upper
        self._hang(node)
        return upper

    def expanded(self) -> Iterator[tuple[bytes, bytes | None, int, int, int, int]]:
        """(digest, that of its parent, depth, bytes of the last turn, members, smallest member) of every prefix."""
        order = [self.root]
        for node in order:
            order.extend(node.children.values())
        members = {}
        for node in reversed(order):
            below = [members[id(c)] for c in node.children.values()]
            least = [x for x in (node.least, *(m for _, m in below)) if x is not None]
            members[id(node)] = n, smallest = node.ends + sum(c for c, _ in below), min(least, default=None)
            if not n:
                continue
            for depth in range(max(node.above, 0) + 1, node.depth + 1):
                above = node.digest(depth - 1) if depth > 1 else ROOT
                yield node.digest(depth), above, depth, node.sizes[depth - 1], n, smallest
            if node is self.root:
                yield ROOT, None, 0, 0, n, smallest


_ROWS = pa.schema([("digest", pa.binary()), ("above", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()),
                   ("n_convs", pa.int64()), ("owner", pa.int64())])


def prefixes(conversations: DataFrame, held: int = HELD) -> DataFrame:
    """(digest, above, depth, bytes, n_convs, owner) of every distinct prefix of the given ``paths``."""
    def rows(trie: ZFastTrie) -> Iterator[pa.RecordBatch]:
        found = list(trie.expanded())
        if found:
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), _ROWS.types, strict=True)]
            yield pa.record_batch(columns, schema=_ROWS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie()
        for batch in batches:
            equal: dict[bytes, list] = {}
            for conv, path, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = equal.setdefault(path[-SIZE:], [path, sizes, 0, conv])
                known[2] += 1
                known[3] = min(known[3], conv)
            for own in equal.values():
                trie.insert(*own)
                if trie.held >= held:
                    yield from rows(trie)
                    trie = ZFastTrie()
        yield from rows(trie)

    schema = "digest binary, above binary, depth bigint, bytes bigint, n_convs bigint, owner bigint"
    parts = conversations.select("conv_id", "path", "bytes").mapInArrow(build, schema)
    return parts.groupBy("digest", "above", "depth", "bytes").agg(F.sum("n_convs").alias("n_convs"), F.min("owner").alias("owner"))


def end_hashes(conversations: DataFrame) -> DataFrame:
    """(digest, ends_sha256): SHA-256 of the ids of the conversations that end at a node, ascending and comma-joined."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs: list[tuple[bytes, int, list[str]]] = []
            for digest, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not runs or runs[-1][0] != digest:
                    runs.append((digest, conv, []))
                runs[-1][2].append(str(conv))
            yield pa.record_batch([pa.array([r[0] for r in runs], pa.binary()), pa.array([r[1] for r in runs], pa.int64()),
                                   pa.array([",".join(r[2]) for r in runs])], ["digest", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = state = None
        for batch in batches:
            done = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                text = ids.as_py().encode()
                if own == digest:
                    state.update(b"," + text)
                    continue
                if state:
                    done.append((digest, state.hexdigest()))
                digest, state = own, hashlib.sha256(text)
            yield hashes(done)
        if state:
            yield hashes([(digest, state.hexdigest())])

    def hashes(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([d for d, _ in done], pa.binary()), pa.array([h for _, h in done], pa.string())],
                               ["digest", "ends_sha256"])

    last = F.expr(f"if(length(path) = 0, unhex('{ROOT.hex()}'), substring(path, -{SIZE}))")
    ends = conversations.select(last.alias("digest"), "conv_id")
    sorted_ = ends.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    segments = sorted_.mapInArrow(joined, "digest binary, first bigint, ids string")
    return segments.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(
        hashed, "digest binary, ends_sha256 string")


def _stretches(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv, owner, upto): whom the nodes on each owner's path belong to, and down to which depth."""
    owners = conversations.join(nodes.select(F.col("owner").alias("conv_id")).distinct(), "conv_id", "left_semi")
    at = F.explode(F.expr(f"sequence(0, cast(length(path) / {SIZE} as int))")).alias("depth")
    digest = F.expr(f"if(depth = 0, unhex('{ROOT.hex()}'), substring(path, {SIZE} * (depth - 1) + 1, {SIZE}))")
    steps = stored(owners.select(F.col("conv_id").alias("conv"), "path", at).select(
        "conv", F.col("depth").cast("bigint").alias("depth"), digest.alias("digest")), "path-steps")
    met = meet(steps, nodes.select("digest", "owner"), "digest")
    return met.groupBy("conv", "owner").agg(F.max("depth").alias("upto"))


def trie(conversations: DataFrame, held: int = HELD) -> DataFrame:
    """One row per node of the trie of ``sequences``: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (bytes that members after the first repeat, over the subtree) and ends_sha256."""
    known = stored(paths(conversations), "conversation-paths")
    nodes = stored(prefixes(known, held), "prefixes")
    children = nodes.filter("above is not null").groupBy(F.col("above").alias("digest")).agg(F.count("*").alias("n_children"))
    saved = ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
    full = stored(nodes.join(children, "digest", "left").select(
        "digest", "depth", "owner", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), saved,
    ).withColumn("leaf", (F.col("n_children") == 0).cast("bigint")), "nodes")

    stretches = stored(_stretches(full, known).filter("conv <> owner"), "stretches")
    own = full.groupBy(F.col("owner").alias("conv")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    below = stretches.join(own, "conv").groupBy("owner", F.col("upto").alias("depth")).agg(
        F.sum("saved").alias("saved_below"), F.sum("leaf").alias("leaf_below"))
    hangs = stretches.groupBy(F.col("conv").alias("owner")).agg(F.max(F.struct("upto", "owner")).alias("at"))
    down = Window.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)

    def subtree(name: str) -> Column:
        return F.sum(F.col(name) + F.coalesce(F.col(f"{name}_below"), F.lit(0))).over(down).cast("bigint")

    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("at")["upto"] + 1, F.col("at")["owner"]).otherwise(F.col("owner"))
    rows = full.join(below, ["owner", "depth"], "left").join(hangs, "owner", "left").join(end_hashes(known), "digest", "left")
    return rows.select(
        F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children",
        subtree("leaf").alias("n_leaves"), subtree("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
