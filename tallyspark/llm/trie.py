"""Prefix trie of conversations, by union-find over the common prefixes of sorted neighbours.

A conversation is a sequence of turns; a turn is 16 bytes of the SHA-256 of its role and text, so texts never travel.
Conversations are sorted by these sequences (and by id where they are equal). An edge joins neighbours; its depth is the
length of their longest common prefix (LCP).

1. Each task takes its range in pieces of ``PIECE`` rows. Inside a piece, edges are worked off in descending depth. All
   components that meet at depth d become one, which is the trie's node of that depth; a component that was deeper is a
   child, and is finished. Counts, the smallest member and saved words are added up as components merge: whenever two
   meet at depth d, the conversation that is not the smallest any more shares d turns with a smaller one.
2. Nodes that hold the first or the last row of a piece stay open, as neighbours may share them. The piece is contracted:
   what hangs from an open node becomes one component of that depth. A list of such components is worked off like
   rows, so pieces are merged inside their task and tasks ``FAN_IN`` at a time, until one list is left.
3. Children that are finished before their open parent carry a digest of the parent's sequence, which is resolved at
   the end. Ids that end at an open node are sent in blocks, in ascending order, and hashed as a stream.

A run of turns without a branch is one component; its nodes are written out one per depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, staged

DIGEST = 16
#: Rows and bytes of keys that are worked off at a time, lists merged at a time, and ids of a block.
PIECE, PIECE_BYTES, FAN_IN, BLOCK = 1 << 16, 1 << 25, 64, 1 << 10
NOTHING = hashlib.sha256(b"").hexdigest()
#: Rows of three kinds: finished nodes, components of a contracted list, blocks of ids that end at an open node.
NODE, PART, IDS = 0, 1, 2
FIELDS = [
    ("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int32()), ("parent", pa.int64()), ("parent_ref", pa.binary()),
    ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.int64()),
    ("sha", pa.string()), ("ends_ref", pa.binary()), ("ref", pa.binary()), ("part", pa.int32()), ("pos", pa.int32()),
    ("side", pa.int32()), ("key", pa.binary()), ("words", pa.list_(pa.int64())), ("ids", pa.string()),
]
ARROW = pa.schema(FIELDS)
SCHEMA = (
    "kind int, conv_id long, depth int, parent long, parent_ref binary, n long, children long, leaves long, saved long, ends long, "
    "sha string, ends_ref binary, ref binary, part int, pos int, side int, key binary, words array<bigint>, ids string"
)


class Part:
    """A component: conversations that share the first ``depth`` turns of ``key``.

    ``words`` sums up the words of the turns before each depth, from ``at`` on. ``saved`` adds up, over all members but
    the smallest, the words of the longest prefix shared with a smaller one. ``leaves`` are those below (0: childless).
    """

    __slots__ = ("key", "words", "at", "depth", "n", "least", "saved", "children", "leaves", "ends", "side")

    def __init__(self, key, words, at, depth, n, least, saved=0, children=0, leaves=0, ends=0, side=0):
        self.key, self.words, self.at, self.depth, self.n, self.least = key, words, at, depth, n, least
        self.saved, self.children, self.leaves, self.ends, self.side = saved, children, leaves, ends, side

    def before(self, depth: int) -> int:
        return int(self.words[self.at + depth] - self.words[self.at])


def shared(a: Part, b: Part) -> int:
    """Turns that two neighbours have in common."""
    n, x, y = min(a.depth, b.depth), a.key, b.key
    if x is y:
        return n
    if n < 8:
        return next((i for i in range(n) if x[i * DIGEST : (i + 1) * DIGEST] != y[i * DIGEST : (i + 1) * DIGEST]), n)
    other = np.frombuffer(x, np.uint64, 2 * n) != np.frombuffer(y, np.uint64, 2 * n)
    first = int(other.argmax())
    return first // 2 if other[first] else n


def joined(parts: list[Part], depth: int, like: Part, side: int = 0) -> Part:
    """The component that the parts, which share ``depth`` turns, become when they meet at that depth."""
    below = [p for p in parts if p.depth > depth]
    same = [p for p in parts if p.depth == depth]
    return Part(
        like.key, like.words, like.at, depth, sum(p.n for p in parts), min(p.least for p in parts),
        sum(p.saved for p in parts) + (len(parts) - 1) * like.before(depth),
        len(below) + sum(p.children for p in same),
        sum(p.leaves or 1 for p in below) + sum(p.leaves for p in same),
        sum(p.ends for p in same), side,
    )


class Refs:
    """Digests of sequences that stand for nodes which are finished elsewhere."""

    def __init__(self):
        self.known: dict[tuple[int, int], bytes] = {}
        self.held: list[bytes] = []  # so that no id is used again

    def __call__(self, part: Part, depth: int) -> bytes:
        at = id(part.key), depth
        if at not in self.known:
            self.held.append(part.key)
            self.known[at] = hashlib.sha256(part.key[: depth * DIGEST]).digest()[:DIGEST]
        return self.known[at]


def forest(parts: list[Part], whole: bool, rows: np.ndarray | None = None) -> tuple[list[Part], Iterator[pa.RecordBatch]]:
    """The contracted list, and the finished nodes (and blocks of ids) as batches.

    ``rows`` has the conversation of each part if the parts are single rows. With ``whole`` there are no neighbours,
    so that all nodes are finished and nothing is left.
    """
    last, refs = len(parts) - 1, Refs()
    edges = np.fromiter((shared(a, b) for a, b in zip(parts, parts[1:])), np.int64, last)
    order = np.argsort(-edges, kind="stable").tolist()
    depths = edges.tolist()
    up, right, now = list(range(last + 1)), list(range(last + 1)), list(parts)  # a component's root is its first place
    done: list[tuple] = []  # component, place of its first row, depth of the parent, its least (None: open) and digest
    blocks: list[tuple[bytes, list[int]]] = []
    sides: tuple[list[Part], ...] = ([], [], [])

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def is_open(root: int) -> bool:
        return not whole and (root == 0 or right[root] == last)

    for depth, group in groupby(order, key=lambda e: depths[e]):
        group = sorted(group)
        roots: list[int] = []
        for e in group:
            for root in (find(e), e + 1):  # a component's right neighbour starts there
                if not roots or roots[-1] != root:
                    roots.append(root)
        met: dict[int, list[int]] = {}
        joins = set(group)
        for root in roots:
            if root and root - 1 in joins:
                top = next(reversed(met))
                met[top].append(root)
            else:
                met[root] = [root]
        for top, members in met.items():
            held = [now[r] for r in members]
            shut = [not is_open(r) for r in members]
            for r in members[1:]:
                up[r] = top
            right[top] = right[members[-1]]
            parent = joined(held, depth, held[0])
            now[top] = parent
            pending = is_open(top)
            ref = None
            if pending:
                edge = 2 if top else 1 if right[top] == last else 0
                closed = [p for p, s in zip(held, shut) if s]
                if closed:
                    like = parts[last] if edge == 2 else parts[0]
                    ref = refs(like, depth)
                    sides[edge].append(joined(closed, depth, like, int(edge == 2)))
                    if rows is not None and (ids := [int(rows[r]) for r, p, s in zip(members, held, shut) if s and p.depth == depth]):
                        blocks.append((ref, ids))
            for r, p, s in zip(members, held, shut):
                if s and p.depth > depth:
                    done.append((p, r, depth, None if pending else parent.least, ref))
    if whole:
        done.append((now[0], 0, -1, None, None))
        rest = []
    else:
        rest = [parts[0], *sides[0], *sides[1], *reversed(sides[2]), *([parts[last]] if last else [])]
        rest[0].side, rest[-1].side = 0, int(last > 0)
        if rows is not None:
            blocks += [(refs(parts[i], parts[i].depth), [int(rows[i])]) for i in {0, last}]
    return rest, _written(done, blocks, rows, refs)


def _batch(size: int, /, **columns) -> pa.RecordBatch:
    arrays = [columns[f] if isinstance(columns.get(f), pa.Array) else pa.array(columns[f], t) if f in columns else pa.nulls(size, t) for f, t in FIELDS]
    return pa.RecordBatch.from_arrays(arrays, schema=ARROW)


def _written(done: list[tuple], blocks: list[tuple[bytes, list[int]]], rows: np.ndarray | None, refs: Refs) -> Iterator[pa.RecordBatch]:
    """Finished components as one row per depth, and blocks of ids."""
    for begin in range(0, len(done), 1 << 14):
        some = done[begin : begin + (1 << 14)]
        bottom, above = np.array([x[0].depth for x in some]), np.array([x[2] for x in some])
        runs = bottom - above
        which = np.repeat(np.arange(len(some)), runs)
        ends = np.cumsum(runs)
        depth = np.arange(ends[-1]) - np.repeat(ends - runs, runs) + above[which] + 1
        n, least = np.array([x[0].n for x in some]), np.array([x[0].least for x in some])
        total = np.array([x[0].saved for x in some])
        prefix = np.zeros(len(which), np.int64)
        for i in np.flatnonzero(n > 1):
            p, from_ = some[i][0], max(int(above[i]), 0)
            sums = p.words[p.at + from_ : p.at + p.depth] - p.words[p.at]
            prefix[ends[i] - len(sums) : ends[i]] = sums
        is_top, is_bottom = depth == above[which] + 1, depth == bottom[which]
        parent = pa.array(np.where(is_top, np.array([x[3] or 0 for x in some])[which], least[which]), mask=is_top & np.array([x[3] is None for x in some])[which])
        size = len(which)
        parent_ref, sha, ends_ref, ref = np.full(size, None), np.full(size, NOTHING, object), np.full(size, None), np.full(size, None)
        for i, (p, first, _, _, up) in enumerate(some):
            if up is not None:
                parent_ref[ends[i] - runs[i]] = up
            low = ends[i] - 1
            if rows is None:
                ref[low] = refs(p, p.depth)
            if p.ends and rows is not None:
                sha[low] = hashlib.sha256(",".join(map(str, rows[first : first + p.ends].tolist())).encode()).hexdigest()
            elif p.ends:
                sha[low], ends_ref[low] = None, refs(p, p.depth)
        yield _batch(
            size, kind=np.full(size, NODE), conv_id=least[which], depth=depth, parent=parent, parent_ref=parent_ref.tolist(), n=n[which],
            children=np.where(is_bottom, np.array([x[0].children for x in some])[which], 1),
            leaves=np.array([x[0].leaves or 1 for x in some])[which], saved=total[which] - (n[which] - 1) * prefix,
            sha=sha.tolist(), ends_ref=ends_ref.tolist(), ref=ref.tolist(),
        )
    cut = [(ref, ids[i : i + BLOCK]) for ref, ids in blocks for i in range(0, len(ids), BLOCK)]
    for begin in range(0, len(cut), 1 << 10):
        some = cut[begin : begin + (1 << 10)]
        yield _batch(len(some), kind=np.full(len(some), IDS), ref=[r for r, _ in some], conv_id=[x[0] for _, x in some], ids=[",".join(map(str, x)) for _, x in some])


def _listed(parts: list[Part], number: int) -> pa.RecordBatch:
    """A contracted list; the first and the last component have a key, the others are prefixes of one of them."""
    ends = {0, len(parts) - 1}
    return _batch(
        len(parts), kind=np.full(len(parts), PART), part=np.full(len(parts), number), pos=np.arange(len(parts)), side=[p.side for p in parts],
        key=[p.key if i in ends else None for i, p in enumerate(parts)],
        words=[(p.words[p.at : p.at + len(p.key) // DIGEST + 1] - p.words[p.at]).tolist() if i in ends else None for i, p in enumerate(parts)],
        **{f: [getattr(p, a) for p in parts] for f, a in (("depth", "depth"), ("n", "n"), ("conv_id", "least"), ("saved", "saved"), ("children", "children"), ("leaves", "leaves"), ("ends", "ends"))},
    )


def _read(table: pa.Table) -> list[Part]:
    """Contracted lists, one behind the other."""
    out: list[Part] = []
    for _, rows in groupby(table.sort_by([("part", "ascending"), ("pos", "ascending")]).to_pylist(), key=lambda r: r["part"]):
        rows = list(rows)
        paths = [(r["key"], np.array(r["words"], np.int64)) for r in (rows[0], rows[-1])]
        for r in rows:
            key, words = paths[r["side"]]
            out.append(Part(key, words, 0, r["depth"], r["n"], r["conv_id"], r["saved"], r["children"], r["leaves"], r["ends"], r["side"]))
    return out


def _pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, list[Part]]]:
    held: list[pa.RecordBatch] = []
    n = size = 0

    def piece() -> tuple[np.ndarray, list[Part]]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, keys = table.column("conv_id").to_numpy(), table.column("key").to_pylist()
        counts = np.concatenate([c.flatten().to_numpy() for c in table.column("words").chunks])
        sums = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        at = np.cumsum([0] + [len(k) // DIGEST for k in keys])
        return ids, [Part(k, sums, int(a), len(k) // DIGEST, 1, int(i), ends=1) for k, a, i in zip(keys, at, ids)]

    for batch in batches:
        step = 0
        while step < batch.num_rows:
            some = batch.slice(step, limit - n)
            held.append(some)
            step, n, size = step + some.num_rows, n + some.num_rows, size + some.nbytes
            if n >= limit or size >= PIECE_BYTES:
                yield piece()
                held, n, size = [], 0, 0
    if held:
        yield piece()


def _forests(piece: int, fan_in: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes of a task's sorted rows finished nodes and one contracted list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: list[list[Part]] = []
        for ids, parts in _pieces(batches, piece):
            rest, nodes = forest(parts, False, ids)
            yield from nodes
            lists.append(rest)
            if len(lists) == fan_in:
                rest, nodes = forest([p for x in lists for p in x], False)
                yield from nodes
                lists = [rest]
        if lists:
            rest, nodes = forest([p for x in lists for p in x], False) if len(lists) > 1 else (lists[0], ())
            yield from nodes
            yield _listed(rest, TaskContext.get().partitionId())

    return run


def _merging(whole: bool, fan_in: int) -> Callable[[pa.Table], pa.Table]:
    """Makes one list of some neighbouring ones."""

    def merge(group: pa.Table) -> pa.Table:
        rest, nodes = forest(_read(group), whole)
        return pa.Table.from_batches([*nodes, *([_listed(rest, group.column("part")[0].as_py() // fan_in)] if rest else [])], ARROW)

    return merge


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ends_ref, sha): the ids of each node, block by block."""
    now, state = None, None
    for batch in batches:
        for ref, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ref != now:
                if state is not None:
                    yield pa.RecordBatch.from_pydict({"ends_ref": [now], "sha": [state.hexdigest()]})
                now, state = ref, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        yield pa.RecordBatch.from_pydict({"ends_ref": [now], "sha": [state.hexdigest()]})


def rebuilt(turns: DataFrame, every: int = 20) -> DataFrame:
    """(conv_id, key, words): the turns of each conversation as 16 bytes each, and the words of each turn.

    The first h = crc32(conv_id) % 4 turns are those of conversation conv_id - conv_id % ``every`` (all it has, if fewer,
    and none if it is absent); the conversation's own turns follow from its number h on. Turns are ordered by ``turn``,
    null first; turns of one number by their digests, and repeated rows are separate turns. A null role or text is
    empty. Rows without a conv_id belong to no conversation. A conversation is one row (20 bytes a turn).
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct("turn", F.unhex(F.substring(F.sha2(said, 256), 1, 2 * DIGEST)).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    head = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, 3).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    out = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(head, "base", "left")
    none = F.slice("own", 1, F.lit(0))
    all_ = F.concat(F.slice(F.coalesce("head", none), 1, h), F.slice("own", h + 1, F.size("own")))
    out = out.select("conv_id", all_.alias("t"))
    key = F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t.digest)), ""))
    return out.select("conv_id", key.alias("key"), F.transform("t", lambda t: t.words).alias("words"))


def prefix_trie(sequences: DataFrame, piece: int = PIECE, fan_in: int = FAN_IN) -> DataFrame:
    """One row per node of the trie of ``sequences`` (conv_id, key, words); see ``trie_table`` for the columns.

    Conv_ids are not null and unique. An empty table has no nodes. A task works off ``piece`` rows at a time; ``fan_in``
    neighbouring lists are merged at a time.
    """
    ordered = sequences.select("conv_id", "key", "words").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    levels = [staged(ordered.mapInArrow(_forests(piece, fan_in), SCHEMA), "forests")]
    while (top := levels[-1].filter(f"kind = {PART}").agg(F.max("part")).first()[0]) is not None:
        lists = levels[-1].filter(f"kind = {PART}")
        levels.append(staged(lists.groupBy(F.expr(f"part div {fan_in}")).applyInArrow(_merging(top < fan_in, fan_in), SCHEMA), "merged"))
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.union(level)
    # Few rows: nodes that lay across pieces or tasks. They are broadcast only if their files are small.
    known = staged(nodes.filter(f"kind = {NODE} and ref is not null").select(F.col("ref").alias("parent_ref"), F.col("conv_id").alias("found")), "parents")
    blocks = levels[0].filter(f"kind = {IDS}").select(F.col("ref").alias("ends_ref"), "conv_id", "ids")
    ends = staged(blocks.repartition("ends_ref").sortWithinPartitions("ends_ref", "conv_id").select("ends_ref", "ids").mapInArrow(_hashed, "ends_ref binary, sha string"), "ends")
    nodes = nodes.filter(f"kind = {NODE}").select("conv_id", "depth", "parent", "parent_ref", "n", "children", "leaves", "saved", "sha", "ends_ref")
    across = nodes.filter("ends_ref is not null").drop("sha").join(ends, "ends_ref").select(*nodes.columns)
    nodes = nodes.filter("ends_ref is null").union(across)
    below = nodes.filter("parent_ref is not null").drop("parent").join(known, "parent_ref").withColumnRenamed("found", "parent")
    nodes = nodes.filter("parent_ref is null").union(below.select(*nodes.columns))
    return nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"),
    )


def trie_table(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (see ``rebuilt``), one row per node.

    conv_id (the smallest member), depth, parent_conv_id (of the parent; null for the root), n_convs (members),
    n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree, the words of each node's turn
    for all members but one) and ends_sha256 (of the ids that end there, ascending, joined by commas).
    """
    return prefix_trie(rebuilt(turns))
