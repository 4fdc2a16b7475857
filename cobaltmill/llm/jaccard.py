"""Join texts whose word shingle sets have a high Jaccard similarity, and group them.

Two sets A and B are linked when ``100 * |A and B| >= percent * |A or B|``. Then their symmetric
difference has at most ``D(|A|, |B|)`` elements, and the join finds every such pair:

1. Sizes fall into overlapping windows, so that each linked pair shares a window. Within a window a
   hash deals every shingle to one of ``m`` blocks; the block's value is the XOR of its shingle hashes.
2. An element of the symmetric difference changes one block, so at most D blocks differ. A set emits
   the values of its first ``D + 1`` rich blocks, D taken for its largest partner: the first unchanged
   such block is among them on both sides. A set with too few such blocks also emits those with one
   shingle or more, and with too few of these a common key. A block is rich with ``RICH`` shingles, or
   with fewer where ``percent`` leaves too few of them in most sets.
3. Equal values are joined. Equal sets are one node from the start. In each key group a pivot is
   tested against the members outside its component.
4. After a few rounds, the pairs of open groups of ``SMALL`` members at most are tested all. Sets in larger
   open groups, such as texts with a common passage, are dealt to ``FINE`` times as many blocks. A block's value is a token there, an empty block's too; all sets of
   a window have equally many, and linked sets differ in D at most. So the D + 1 rarest tokens of a
   set, by exact counts, meet those of each partner, and what many texts share falls out. Pivots come
   first here too, as long as they link.
5. A pair is tested by XORed parity bits first (each shingle flips one of 256 bits, so the Hamming
   distance of two sketches is a lower bound of the symmetric difference). Of larger sets, which 256
   bits can't tell apart, as many bits as D asks for are compared next, then the sets.

Sets, nodes and block values are told apart by 64-bit hashes. Groups are combined before shuffles,
and links inside a component already found are not sought.

Defined results:

- null or wordless text: 0 shingles, linked with nothing, a component of its own id;
- null id: never the smallest of a component that has other ids; a component without ids is null;
- repeated rows and equal sets are linked; rows are told apart by nothing but their set and id;
- an empty table gives no rows; other columns are ignored by ``components`` and pass ``near_dedup``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cobaltmill.llm.common import free_names, text_batches
from cobaltmill.llm.shingles import batch_slices, scramble, shingle_sets
from cobaltmill.session import discard, materialise, table

WIDTH = 4
PERCENT = 85
RICH = 3
SLICE = 1 << 20
PIVOT_ROUNDS = 2
FINE = 4
SMALL = 16
#: The most further rounds of pivots while they link; pairs that remain are tested one by one.
FINE_ROUNDS = 3
#: The keys are dealt to so many parts, one after the other, when those that rows share are sought.
KEY_PARTS = 2
PARITY = ("p0", "p1", "p2", "p3")


def most_apart(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference of linked sets with ``a`` and ``b`` elements."""
    return (100 - percent) * (a + b) // (100 + percent)


def windows(percent: int) -> list[tuple[int, int]]:
    """Size windows (low, high); every pair of sizes that can be linked shares one at least."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low * 1_000_000 // percent ** 3, low * 5 // 4)
        out.append((low, high))
        low = -(-percent * (high + 1) // 100)  # the smallest partner of the next size
    return out


def rich_size(percent: int) -> int:
    """The shingles of a rich block: ``RICH``, or as many as leave D + 1 rich blocks in most sets."""
    load = 5 * (100 + percent) / (12 * max(100 - percent, 1))  # mean of the blocks of ``block_keys``
    for least in range(RICH, 1, -1):
        poorer = math.exp(-load) * sum(load ** k / math.factorial(k) for k in range(least))
        if 1.2 * (1 - poorer) > 1.05:
            return least
    return 1


def block_keys(found: np.ndarray, percent: int, spans: list[tuple[int, int]]) -> list[np.ndarray]:
    """The join keys of one set of distinct hashes."""
    n, keys, least = len(found), [], rich_size(percent)
    largest = n * 100 // percent
    for number, (low, high) in enumerate(spans):
        if not low <= n <= high:
            continue
        need = most_apart(n, min(high, largest), percent) + 1
        blocks = (most_apart(high, high, percent) + 1) * 6 // 5 + 2 if high > 2 * RICH else 1
        block = (scramble(found + np.uint64(number)) >> np.uint64(32)) % np.uint64(blocks)
        order = np.argsort(block, kind="stable")
        used, at, size = np.unique(block[order], return_index=True, return_counts=True)
        value = np.bitwise_xor.reduceat(found[order], at)
        named = scramble(value ^ scramble(used * np.uint64(4096) + np.uint64(number)))
        rich = np.flatnonzero(size >= least)
        keys.append(named[rich[:need]])
        if len(rich) < need:
            if least > 1:
                keys.append(scramble(named[:need] + np.uint64(1)))
            if len(named) < need:
                keys.append(scramble(np.array([number], dtype=np.uint64)))
    return keys


def block_tokens(found: np.ndarray, percent: int, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each window of a set its number, the number of tokens to keep, and one token for each fine block."""
    n = len(found)
    for number, (low, high) in enumerate(spans):
        if low <= n <= high:
            blocks = FINE * (most_apart(high, high, percent) + 1)
            block = (scramble(found ^ np.uint64(number + 1)) >> np.uint64(32)) % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            used, at = np.unique(block[order], return_index=True)
            value = np.zeros(blocks, np.uint64)
            value[used.astype(np.int64)] = np.bitwise_xor.reduceat(found[order], at)
            place = scramble(np.arange(blocks, dtype=np.uint64) * np.uint64(4096) + np.uint64(number))
            yield number, most_apart(n, min(high, n * 100 // percent), percent) + 1, scramble(value ^ place)


def parity(found: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of the number of hashes that fall on it, as four numbers."""
    bits = np.bincount((found >> np.uint64(7) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def wide_parity(found: np.ndarray, percent: int) -> np.ndarray:
    """Parity bits, a power of two and at least 4 D, as 64-bit numbers; none where 256 bits are as many.

    Bits of a larger set are folded to those of a smaller one by XORing halves.
    """
    bits = 1 << (4 * most_apart(len(found), len(found), percent)).bit_length()
    if bits <= 256:
        return np.zeros(0, dtype=np.int64)
    place = (found >> np.uint64(16) & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit numbers as one Arrow column."""
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).view(np.int64)))


def _signer(id_type: pa.DataType, width: int, percent: int):
    spans = windows(percent)

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batch_slices(batches, "text", SLICE):
            sets = shingle_sets(part.column("text").to_pylist(), width)
            keys = [block_keys(s, percent, spans) if len(s) else [] for s in sets]
            flat = [np.concatenate(k) if k else np.zeros(0, dtype=np.uint64) for k in keys]
            bits = np.stack([parity(s) for s in sets])
            node = np.array([np.bitwise_xor.reduce(scramble(s)) ^ np.uint64(len(s)) for s in sets],
                            dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(id_type), part.column("text_hash"),
                 pa.array([len(s) for s in sets], pa.int64()), pa.array(node.view(np.int64)),
                 *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(4)],
                 _lists([wide_parity(s, percent) for s in sets]), _lists(flat)],
                names=["doc_id", "text_hash", "n_shingles", "node", *PARITY, "wide", "keys"])

    return sign


def _setter(width: int):
    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batch_slices(batches, "text", SLICE):
            found = shingle_sets(part.column("text").to_pylist(), width)
            node = np.array([np.bitwise_xor.reduce(scramble(s)) ^ np.uint64(len(s)) for s in found],
                            dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node.view(np.int64)), _lists(found)], names=["node", "shingles"])

    return sets


def _tokeniser(width: int, percent: int):
    spans = windows(percent)

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batch_slices(batches, "text", SLICE):
            asked = part.column("node").to_numpy()
            for wanted, found in zip(asked, shingle_sets(part.column("text").to_pylist(), width)):
                node = (np.bitwise_xor.reduce(scramble(found)) ^ np.uint64(len(found))).view(np.int64)
                rows = [(node, *row) for row in block_tokens(found, percent, spans)] if node == wanted else []
                if rows:
                    nodes, numbers, needs, own = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes, pa.int64()), pa.array(numbers, pa.int32()), pa.array(needs, pa.int32()),
                         pa.array([t.view(np.int64) for t in own], pa.list_(pa.int64()))],
                        names=["node", "span", "need", "tokens"])

    return tokens


def profiles(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_hash, n_shingles, node`` (hash of the set), parity bits (``wide`` of larger sets) and join ``keys`` per row."""
    id_field = docs.schema["doc_id"]
    schema = T.StructType([
        T.StructField("doc_id", id_field.dataType), T.StructField("text_hash", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("node", T.LongType()), *[T.StructField(p, T.LongType()) for p in PARITY],
        T.StructField("wide", T.ArrayType(T.LongType())), T.StructField("keys", T.ArrayType(T.LongType()))])
    return text_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _signer(to_arrow_type(id_field.dataType), width, percent), schema)


def _far(a: str, b: str, percent: int) -> Column:
    """True if the parity bits prove that two nodes aren't linked."""
    apart = sum((F.bit_count(F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))) for p in PARITY), F.lit(0))
    smaller, larger = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    return _too_many(apart, a, b, percent) | (smaller * 100 < larger * percent)


def _far_wide(a: str, b: str, percent: int) -> Column:
    """True if the wide parity bits prove that two nodes aren't linked."""
    one, other = F.col(f"{a}wide"), F.col(f"{b}wide")
    swap = F.size(one) > F.size(other)
    few, many = F.when(swap, other).otherwise(one), F.when(swap, one).otherwise(other)

    def folded(at: Column) -> Column:
        return F.aggregate(F.sequence(at, F.size(many) - 1, F.size(few)), F.lit(0).cast("long"),
                           lambda x, k: x.bitwiseXOR(F.get(many, k)))

    apart = F.aggregate(F.sequence(F.lit(0), F.size(few) - 1), F.lit(0),
                        lambda n, k: n + F.bit_count(F.get(few, k).bitwiseXOR(folded(k))))
    return (F.size(few) > 0) & _too_many(F.when(F.size(few) > 0, apart).otherwise(0), a, b, percent)


def _too_many(apart: Column, a: str, b: str, percent: int) -> Column:
    """True if so many elements on one side only are more than linked sets have."""
    return apart * (100 + percent) > (100 - percent) * (F.col(f"{a}n") + F.col(f"{b}n"))


class _Links:
    """Tests pairs of nodes by their texts."""

    def __init__(self, docs: DataFrame, stored: DataFrame, nodes: DataFrame, width: int, percent: int):
        self.docs, self.stored, self.nodes = docs, stored, nodes
        self.width, self.percent = width, percent

    def named(self, side: str, *bits: str) -> DataFrame:
        return self.nodes.select(
            F.col("node").alias(side), F.col("n").alias(f"{side}n"), *[F.col(p).alias(f"{side}{p}") for p in bits])

    def near(self, pairs: DataFrame, far: Callable[[str, str, int], Column], *bits: str) -> DataFrame | None:
        """The stored pairs that these bits don't prove to be far, stored; None without any."""
        near = materialise(
            pairs.join(self.named("a", *bits), "a").join(self.named("b", *bits), "b")
            .filter(~far("a", "b", self.percent)).select(*pairs.columns), "near-close")
        if near.isEmpty():
            discard(near)
            return None
        return near

    def texts(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The texts of the rows that first hold the asked nodes, and these rows; other nodes may be among them."""
        owners = self.stored.select("node", "doc_id").join(asked, "node").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"))
        owners = materialise(owners, "near-owners")
        ids = owners.select(F.col("doc_id").alias("owner")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("owner"))
        return self.docs.select("doc_id", "text").join(ids, same, "left_semi"), owners

    def refined(self, open_nodes: DataFrame) -> DataFrame:
        """``key, node``: the rarest tokens of the asked nodes, as many as meet those of every partner."""
        texts, owners = self.texts(open_nodes)
        named = owners.select("node", F.col("doc_id").alias("owner"))
        asked = texts.join(named, F.col("doc_id").eqNullSafe(F.col("owner"))).select("node", "text")
        fine = materialise(asked.mapInArrow(
            _tokeniser(self.width, self.percent), "node long, span int, need int, tokens array<long>"), "near-tokens")
        each = fine.select("node", "span", F.explode("tokens").alias("key"))
        shared = materialise(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-keys")
        met = each.join(shared, "key").groupBy("node", "span").agg(
            F.sort_array(F.collect_set(F.struct("n", "key"))).alias("met"))  # at most the tokens of one set
        sizes = fine.select("node", "span", "need", F.size("tokens").alias("size")).distinct()
        kept = met.join(sizes, ["node", "span"])
        room = F.greatest(F.col("need") - (F.col("size") - F.size("met")), F.lit(0))
        rare = kept.select("node", F.explode(F.slice("met", 1, room)).alias("m")).select("m.key", "node")
        rare = materialise(rare.distinct(), "near-fine")
        for done in (fine, shared, owners):
            discard(done)
        return rare

    def test(self, pairs: DataFrame) -> DataFrame | None:
        """Those of the stored pairs (a, b, and their roots) that are linked; None without any."""
        if pairs.isEmpty():
            return None
        maybe = self.near(pairs, _far, *PARITY)
        if maybe is None:
            return None
        close = self.near(maybe, _far_wide, "wide")
        discard(maybe)
        if close is None:
            return None
        texts, owners = self.texts(close.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        sets = texts.mapInArrow(_setter(self.width), "node long, shingles array<long>")
        sets = materialise(
            sets.join(owners.select("node"), "node", "left_semi").dropDuplicates(["node"]), "near-sets")
        same = F.size(F.array_intersect("ashingles", "bshingles"))
        union = F.size("ashingles") + F.size("bshingles") - same
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("ashingles"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("bshingles"))
        found = materialise(
            close.join(left, "a").join(right, "b")
            .filter(same * 100 >= union * self.percent).select(*pairs.columns), "near-links")
        for done in (close, owners, sets):
            discard(done)
        if found.isEmpty():
            discard(found)
            return None
        return found


def _is_starred(edges: DataFrame) -> bool:
    """True if every node is either a centre or the end of exactly one edge."""
    ends = edges.select(F.col("a").alias("node"), F.lit(True).alias("centre")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(False).alias("centre")))
    roles = ends.groupBy("node").agg(F.bool_or("centre").alias("centre"), F.count_if(~F.col("centre")).alias("ends"))
    return roles.filter((F.col("centre") & (F.col("ends") > 0)) | (F.col("ends") > 1)).isEmpty()


def connected(edges: DataFrame, tag: str = "components") -> DataFrame:
    """``node, root``: the smallest node that each node of the edges (a, b) can reach.

    Alternates two kinds of star contraction, each a minimum per node and a join, until the edges
    are stars around the roots.
    """
    pair = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = materialise(pair.filter("a < b").distinct(), tag)
    while not _is_starred(stars):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(
            F.col("m").alias("a"), "b").filter("a < b").distinct()
        large = materialise(large, tag)
        discard(stars)
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(
            F.col("m").alias("u"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(
                F.col("a")).alias("v"))
        stars = materialise(
            small.filter("u < v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), tag)
        discard(large)
    roots = stars.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root"))
    rooted = materialise(stars.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots), tag)
    discard(stars)
    return rooted


def components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id, text)."""
    rooted = linked_rows(docs, width, percent)
    alone = rooted.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = rooted.filter("n_shingles > 0")
    least = materialise(linked.groupBy("root").agg(F.min("doc_id").alias("component_id")), "near-least")
    return linked.join(least, "root").select(*alone.columns).unionByName(alone)


def linked_rows(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, text_hash, n_shingles, root``: rows of one root are linked, directly or by others. Stored."""
    # rows are numbered so that a key travels with a short name of its row
    signed = materialise(profiles(docs, width, percent).withColumn("row", F.monotonically_increasing_id()), "near-profiles")
    stored = materialise(signed.drop("keys"), "near-rows")
    keyed = signed.select(F.explode("keys").alias("key"), "row")
    parts = []
    for part in range(KEY_PARTS):  # shuffle files of one part of the keys at a time
        own = keyed.filter(F.pmod("key", F.lit(KEY_PARTS)) == part)
        shared = own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
        shared = materialise(shared, "near-keys")
        parts.append(materialise(own.join(shared, "key"), "near-held"))
        discard(shared)
    discard(signed)
    held = reduce(DataFrame.unionByName, parts)
    named = materialise(held.join(stored.select("row", "node"), "row").select("key", "node").distinct(), "near-named")
    for part in parts:
        discard(part)
    several = named.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    several = materialise(several.select("key"), "near-keys")
    members = materialise(named.join(several, "key"), "near-members")
    discard(named)
    discard(several)
    nodes = materialise(
        stored.join(members.select("node").distinct(), "node", "left_semi")
        .select("node", F.col("n_shingles").alias("n"), *PARITY, "wide").distinct(), "near-nodes")

    work = _Links(docs, stored, nodes, width, percent)
    found = _Groups(work, nodes, percent)
    open_members = found.pivots(found.unsettled(members), PIVOT_ROUNDS)
    discard(members)
    if not open_members.isEmpty():
        sizes = materialise(open_members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "near-sizes")
        small = sizes.filter(F.col("n") <= SMALL).select("key")
        found.all_pairs(open_members.join(small, "key", "left_semi"))
        large = materialise(open_members.join(sizes.filter(F.col("n") > SMALL), "key").select("node").distinct(), "near-open")
        if not large.isEmpty():
            rare = work.refined(large)
            fine_members = found.pivots(found.unsettled(rare), 0)
            discard(rare)
            found.all_pairs(fine_members)
            discard(fine_members)
        discard(large)
        discard(sizes)
    discard(open_members)
    rooted = stored.select("doc_id", "text_hash", "n_shingles", "node")
    if found.found is not None:
        rooted = rooted.join(found.found, "node", "left")
    else:
        rooted = rooted.withColumn("root", F.col("node"))
    rooted = materialise(rooted.select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("root", "node").alias("root")), "near-rooted")
    found.discard()
    for done in (stored, nodes):
        discard(done)
    return rooted


class _Groups:
    """Finds the links within groups of nodes (key, node) and joins the components that they connect."""

    def __init__(self, work: _Links, nodes: DataFrame, percent: int):
        self.work, self.nodes, self.percent = work, nodes, percent
        self.tested: list[DataFrame] = []
        #: ``node, root`` of linked nodes; a node that isn't here is its own root.
        self.found: DataFrame | None = None

    def discard(self) -> None:
        for done in [*self.tested, *([self.found] if self.found is not None else [])]:
            discard(done)

    def unsettled(self, members: DataFrame) -> DataFrame:
        """``key, node, root``: members of the groups that still hold more than one component. Stored."""
        if self.found is None:  # groups have two nodes at least
            return materialise(members.select("key", "node", F.col("node").alias("root")), "near-open")
        rooted = materialise(members.select("key", "node").join(self.found, "node", "left").select(
            "key", "node", F.coalesce("root", "node").alias("root")), "near-rooted")
        several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        still = materialise(rooted.join(several.filter("low < high").select("key"), "key"), "near-open")
        discard(rooted)
        return still

    def try_pairs(self, pairs: DataFrame) -> bool:
        """Test pairs that were not tested before; True if some are linked."""
        if self.tested:
            before = reduce(DataFrame.unionByName, self.tested).select("a", "b")
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "near-pairs")
        self.tested.append(pairs)
        links = self.work.test(pairs)
        if links is None:
            return False
        self.join_roots(links)
        discard(links)
        return True

    def join_roots(self, links: DataFrame) -> None:
        """Only the roots that new links meet are connected; their members follow."""
        moved, old = connected(links.select(F.col("aroot").alias("a"), F.col("broot").alias("b"))), self.found
        if old is None:
            self.found = moved
            return
        to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
        followed = old.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        alone = moved.join(old.select("node"), "node", "left_anti")
        self.found = materialise(followed.unionByName(alone), "components")
        discard(old)
        discard(moved)

    def pivots(self, members: DataFrame, rounds: int) -> DataFrame:
        """Test one member of each open group against the others: ``rounds`` times, then as long as that links.

        Takes stored members and returns those of the groups that stay open, stored.
        """
        turn, linked = 0, True
        while (turn < rounds or linked) and turn < rounds + FINE_ROUNDS and not members.isEmpty():
            pivots = members.groupBy("key").agg(
                F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(turn))).alias("pivot"))
            star = members.join(pivots, "key").filter(F.col("root") != F.col("pivot.root"))
            linked = self.try_pairs(_ordered(star, F.struct("pivot.node", "pivot.root"), F.struct("node", "root")))
            if linked:
                before, members = members, self.unsettled(members)
                discard(before)
            turn += 1
        return members

    def all_pairs(self, members: DataFrame) -> None:
        """Test all pairs of different components that the parity bits allow."""
        signed = members.join(self.nodes, "node")
        left, right = (signed.select("key", *[F.col(c).alias(f"{side}{c}") for c in ("node", "root", "n", *PARITY)])
                       for side in "ab")
        met = left.join(right, "key").filter(
            (F.col("anode") < F.col("bnode")) & (F.col("aroot") != F.col("broot")) & ~_far("a", "b", self.percent))
        self.try_pairs(_ordered(met, F.struct(F.col("anode").alias("node"), F.col("aroot").alias("root")),
                                F.struct(F.col("bnode").alias("node"), F.col("broot").alias("root"))))


def _ordered(rows: DataFrame, one: Column, other: Column) -> DataFrame:
    """``a, b, aroot, broot`` of pairs of (node, root), the smaller node first, each once."""
    pair = rows.select(F.least(one, other).alias("low"), F.greatest(one, other).alias("high"))
    return pair.select(F.col("low.node").alias("a"), F.col("high.node").alias("b"),
                       F.col("low.root").alias("aroot"), F.col("high.root").alias("broot")).distinct()


def near_dedup(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each group of linked texts: the one with the smallest id, if any has one.

    Of repeated rows one stays. Texts without words are no copies of each other and stay.
    """
    rooted = linked_rows(docs, width, percent)
    one, digest, number, repeats = free_names(docs, "head_id", "head_hash", "head_row", "head_rows")
    rows = rooted.filter("n_shingles > 0").groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "n")).alias("head")
    heads = materialise(rows.groupBy("root").agg(head).select(
        F.col("head.doc_id").alias(one), F.col("head.text_hash").alias(digest), F.col("head.n").alias(repeats)), "near-heads")
    discard(rooted)
    worded = F.regexp_like(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]"))
    chosen = F.col("doc_id").eqNullSafe(F.col(one)) & (F.xxhash64("text") == F.col(digest))
    # only the texts of repeated rows are dealt out once more
    once, several = (docs.filter(worded).join(heads.filter(c), chosen, "left_semi")
                     for c in (F.col(repeats) == 1, F.col(repeats) > 1))
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    several = several.withColumn(number, F.row_number().over(same)).filter(F.col(number) == 1).drop(number)
    return once.unionByName(several).unionByName(docs.filter(~worded))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Named steps over a relation ``docs`` (doc_id, text).
COMPONENT_STEPS = rf"""
near_words AS MATERIALIZED (
  SELECT doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM docs),
near_set AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH} + 2),
                                               lambda i: array_to_string(w[i:i + {WIDTH} - 1], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM near_words),
near_size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM near_set GROUP BY 1),
near_link AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM near_set a JOIN near_set b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN near_size m ON m.doc_id = a.doc_id JOIN near_size k ON k.doc_id = b.doc_id
  WHERE m.n * 100 >= {PERCENT} * k.n AND k.n * 100 >= {PERCENT} * m.n
  GROUP BY a.doc_id, b.doc_id, m.n, k.n
  HAVING count(*) * 100 >= {PERCENT} * (m.n + k.n - count(*))),
near_both AS MATERIALIZED (SELECT x, y FROM near_link UNION ALL SELECT y, x FROM near_link),
near_reach AS (
  SELECT x, y FROM near_both UNION
  SELECT r.x, e.y FROM near_reach r JOIN near_both e ON r.y = e.x),
near_component AS (
  SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles,
         least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
  FROM docs d LEFT JOIN near_size s ON s.doc_id = d.doc_id LEFT JOIN near_reach r ON r.x = d.doc_id
  GROUP BY d.doc_id)
"""

SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents),
{COMPONENT_STEPS}
SELECT doc_id, n_shingles, component_id FROM near_component
"""
