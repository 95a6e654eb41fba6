"""N-gram Jaccard self join over count-vector R-trees; exact.

A document is the set of its distinct word shingles. Shingles are hashed into GROUPS groups, and a
set's point is its number of shingles in each. Two sets cannot share more than the sum, over the
groups, of the smaller of their counts, so an R-tree whose nodes hold the largest count of each group
(and the range of sizes) finds all partners that this bound allows; those are verified on the sets.

One tree over billions of points would not be distributed, so there is a tree for each signature.
Linked sets share at least ceil(t * n) of their n shingles, so they share one of the first
n - ceil(t * n) + 1 under any one order of all shingles: those are a set's signatures. The order puts
shingles that many documents hold last (their counts are estimated in a fixed number of buckets;
only the order depends on them, never the result), and by hash otherwise.

Groups of near copies would still make trees with quadratic results, so each signature first offers
only the pairs of every set with its smallest one: the partners of each such centre are an R-tree's points, whatever signatures
they came by, and the centre is sought in it. What these link is one component already; the trees of signatures
are searched only where a signature's sets lie in several components, and only for pairs across them.
A pair would come from the tree of each signature that both sets have. So each set names OWNERS of its
signatures, those with the smallest values, and where two sets name a common one, only the tree of the
smallest such signature gives the pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, mixed, removed, rows_as, small, utf8, windows, written
from .graph import connected_components

#: Upper nodes of a tree have COARSE groups, each of several of the GROUPS of a point; both are powers of two.
WORDS, PERCENT, GROUPS, COARSE = 4, 85, 512, 128
#: Buckets of the shingle counts, those that a task reports at most, and those that are put last.
BUCKETS, REPORTED, FREQUENT = 1 << 20, 4096, 1 << 16
#: Points of a leaf; points up to which a tree is one node, bounded at once; points of one tree. A larger signature is dealt out in pairs of
#: blocks of so many; beyond BLOCKS of them, which would copy a row more often than it has other signatures, it has trees for two shingles.
LEAF, NODE, TREE, BLOCKS = 16, 64, 512, 64
#: Lowest shingles that are kept for each signature, since those that come last are not known yet.
SPARE = 2
#: Signatures that a set names, so that a pair comes from one tree.
OWNERS = 8


def shingles(text: bytes | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """The sorted hashes of a whole text's distinct shingles; of the whole sequence if it is shorter."""
    h = hashes.of((text or b"").lower().split())
    return np.unique(windows(h, min(words, len(h)))) if len(h) else np.empty(0, np.uint64)


def all_shingles(texts: list[bytes | None], hashes: WordHashes, words: int = WORDS, together: int = 256) -> Iterator[np.ndarray]:
    """shingles() of each text; the windows of so many texts are hashed at once, and those across two texts are passed over."""
    for at in range(0, len(texts), together):
        split = [(t or b"").lower().split() for t in texts[at : at + together]]
        h = hashes.of([w for x in split for w in x])
        every, start = windows(h, words), 0
        for x in split:
            n = len(x)
            yield np.unique(every[start : start + n - words + 1] if n >= words else windows(h[start : start + n], n)) if n else np.empty(0, np.uint64)
            start += n


def point(found: np.ndarray) -> bytes:
    """The counts by group, in one byte each, or two or four where one needs them."""
    counts = np.bincount((found >> np.uint64(65 - GROUPS.bit_length())).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.min_scalar_type(counts.max())).tobytes()


def fine_point(found: np.ndarray) -> bytes | None:
    """The counts in so many groups (a power of two) that each has eight shingles or fewer on average; None where GROUPS are that many."""
    bits = max(0, (len(found) - 1) // 8).bit_length()
    if 1 << bits <= GROUPS:
        return None
    return np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16).tobytes()


def bound(p: bytes, q: bytes, fine_p: bytes | None, fine_q: bytes | None) -> int:
    """The sum of the smaller counts, in the groups of the coarser point: groups are ranges of hashes, so finer ones add up to them."""
    if fine_p is None or fine_q is None:
        a, b = counts_of([p, q])
        return int(np.minimum(a, b).sum(dtype=np.int64))
    a, b = np.frombuffer(fine_p, np.uint16).astype(np.int64), np.frombuffer(fine_q, np.uint16).astype(np.int64)
    n = min(len(a), len(b))
    return int(np.minimum(a.reshape(n, -1).sum(1), b.reshape(n, -1).sum(1)).sum())


def counts_of(points: list[bytes]) -> np.ndarray:
    """The points' counts, in one type that holds them all."""
    widths = [len(p) // GROUPS for p in points]
    kind = f"u{max(widths, default=1)}"
    if len(set(widths)) < 2:
        return np.frombuffer(b"".join(points), kind).reshape(-1, GROUPS)
    return np.array([np.frombuffer(p, f"u{w}") for p, w in zip(points, widths, strict=True)], kind)


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest intersection with which sets of a and b shingles are linked."""
    return -(-percent * (a + b) // (100 + percent))


class RTree:
    """Points packed by size and then by their counts into leaves; upper nodes hold FAN nodes each.

    A node has the largest count of each coarse group and the smallest and largest size below it; coarse
    groups are cheap to search by, and the points that they leave are bounded by all groups.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF) -> None:
        n = len(sizes)
        slabs = max(1, int(np.sqrt(n / leaf)))
        slab = (np.argsort(np.argsort(sizes, kind="stable"), kind="stable") * slabs) // max(1, n)
        coarse = self.coarser(points)
        self.order = np.lexsort((coarse[:, 1] if n else sizes, coarse[:, 0] if n else sizes, slab))
        self.points, self.coarse, self.sizes, self.leaf = points[self.order], coarse[self.order], sizes[self.order], leaf
        self.levels = []
        top, low, high = self.coarse, self.sizes, self.sizes
        while len(low) > 1 or not self.levels:
            starts = np.arange(0, len(low), leaf)
            top, low, high = np.maximum.reduceat(top, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.levels.append((top, low, high))

    @staticmethod
    def coarser(points: np.ndarray) -> np.ndarray:
        """Groups are ranges of hashes, so neighbouring ones add up to coarse ones."""
        return points.reshape(len(points), COARSE, GROUPS // COARSE).sum(2, dtype=np.int32)

    def search(self, at: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Positions (in the given order) of the points that the bound allows as partners."""
        nodes, wide = np.arange(len(self.levels[-1][0])), self.coarser(at[None])[0]
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            ok = (high[nodes] * 100 >= size * percent) & (low[nodes] * percent <= size * 100)
            nodes = nodes[ok]
            bound = np.minimum(top[nodes], wide).sum(1)
            least = np.maximum(low[nodes], -(-size * percent // 100))
            nodes = nodes[bound >= least_overlap(size, least, percent)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.sizes)
            nodes = (nodes[:, None] * self.leaf + np.arange(self.leaf)).ravel()
            nodes = nodes[nodes < below]
        for points, point in ((self.coarse, wide), (self.points, at)):
            nodes = nodes[np.minimum(points[nodes], point).sum(1, dtype=np.int64) >= least_overlap(size, self.sizes[nodes], percent)]
        return self.order[nodes]


def within_node(points: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (k < m) of one node's points that wanted (a matrix) names, and that sizes and the bound allow: by coarse groups, then by all."""
    k, m = np.nonzero(np.triu(wanted, 1))
    ok = (sizes[k] * 100 >= sizes[m] * percent) & (sizes[m] * 100 >= sizes[k] * percent)
    k, m = k[ok], m[ok]
    for some in (RTree.coarser(points), points):
        ok = np.minimum(some[k], some[m]).sum(1, dtype=np.int64) >= least_overlap(sizes[k], sizes[m], percent)
        k, m = k[ok], m[ok]
    return k, m


def _taken(n: int, percent: int) -> int:
    """The signatures of a set of n."""
    return n - -(-percent * n // 100) + 1


def _sets(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, key (128 bits of the set), point, fine, low (twice as many of the lowest shingles by hash as there are signatures, in that
    order), and rows of kind bucket: counts of frequent shingles' buckets."""
    def part(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, docs = WordHashes(), np.zeros(BUCKETS, np.int64), 0
        for batch in rows:
            ids = batch.column(0)
            for at in range(0, batch.num_rows, 256):
                sets = list(all_shingles(utf8(batch.column(1).slice(at, 256)), hashes, words))
                docs += len(sets)
                counts += np.bincount((np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                made = [(len(s), xxhash.xxh128_digest(s.tobytes()), point(s), fine_point(s), _lowest(s, SPARE * _taken(len(s), percent)).tobytes()) if len(s) else (0, None, None, None, None) for s in sets]
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), *[pa.binary()] * 4), strict=True)]
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), *columns, none, none], names=names)
        top = np.argpartition(counts, -REPORTED)[-REPORTED:]
        top = top[counts[top] >= max(4, docs // 500, 4 * counts.mean())]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(top), t) for t in (pa.int64(), pa.int64(), *[pa.binary()] * 4)], pa.array(top, pa.int64()), pa.array(counts[top], pa.int64())], names=names)

    names = ["doc_id", "n", "key", "point", "fine", "low", "bucket", "seen"]
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(part, "doc_id long, n long, key binary, point binary, fine binary, low binary, bucket long, seen long")


def _lowest(s: np.ndarray, many: int) -> np.ndarray:
    """So many of a set's shingles that are lowest by hash, in order."""
    order = mixed(s) >> np.uint64(1)
    some = np.argpartition(order, many - 1)[:many] if many < len(s) else np.arange(len(s))
    return s[some[np.argsort(order[some])]]


def _signatures(sets: DataFrame, last: np.ndarray, percent: int, column: str = "low") -> DataFrame:
    """doc_id, key, sigs, beyond (the shingle that comes next, if there is one). last: buckets of the shingles that come last. sigs is
    null where a set's lowest shingles are not enough, since too many of them come last; column items has all shingles, which are."""
    def part(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.zeros(BUCKETS, bool)
        late[last] = True
        for batch in rows:
            sigs, beyond = [], []
            for low, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, take = np.frombuffer(low, np.uint64), _taken(n, percent)
                behind = late[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]
                first = np.concatenate([s[~behind], s[behind]])[: take + 1].view(np.int64) if len(s) == n else s[~behind][: take + 1].view(np.int64)
                enough = len(first) >= min(n, take + 1)
                sigs.append(first[:take].tolist() if enough else None)
                beyond.append(int(first[take]) if enough and take < len(first) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.list_(pa.int64())), pa.array(beyond, pa.int64())], names=["doc_id", "key", "sigs", "beyond"])

    return sets.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "key", column, "n").mapInArrow(part, "doc_id long, key binary, sigs array<long>, beyond long")


def _full(documents: DataFrame, words: int) -> DataFrame:
    """id, n, key and items (the whole set, lowest by hash first, as bytes) of each document."""
    def part(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                sets = list(all_shingles(utf8(batch.column(1).slice(at, 256)), hashes, words))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array([_lowest(s, len(s)).tobytes() for s in sets], pa.binary())], names=["id", "n", "key", "items"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(part, "id long, n long, key binary, items binary")


def _bounded(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and the sum of the smaller counts allow. Sizes first: points travel only with what they leave."""
    def part(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            need = least_overlap(batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
            ok = [bound(*x) >= y for x, y in zip(zip(*[batch.column(k).to_pylist() for k in range(4, 8)], strict=True), need, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = known.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"), F.col("fine").alias("fa"))
    two = known.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"), F.col("fine").alias("fb"))
    sized = pairs.join(one.drop("pa", "fa"), "a").join(two.drop("pb", "fb"), "b")
    sized = sized.where(F.col("na") * 100 >= F.col("nb") * percent).where(F.col("nb") * 100 >= F.col("na") * percent)
    return sized.join(one, ["a", "na"]).join(two, ["b", "nb"]).select("a", "b", "na", "nb", "pa", "pb", "fa", "fb").mapInArrow(part, "a long, b long").distinct()


def _starred(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the tree of a centre's partners allows: the b of each a are an R-tree's points, and a is what is sought in it.

    Rows come sorted by a from the join; a centre that is dealt to several tasks or batches has a tree in each.
    """
    def part(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            if not len(a):
                continue
            pa_, fa, pb, fb = (batch.column(k).to_pylist() for k in range(4, 8))
            ok = np.zeros(len(a), bool)
            new = np.nonzero(np.diff(a))[0] + 1
            for i, j in zip([0, *new.tolist()], [*new.tolist(), len(a)], strict=True):
                points = counts_of([pa_[i], *pb[i:j]])
                for k in RTree(points[1:], nb[i:j]).search(points[0], int(na[i]), percent).tolist():
                    ok[i + k] = fa[i] is None or fb[i + k] is None or bound(b"", b"", fa[i], fb[i + k]) >= least_overlap(int(na[i]), int(nb[i + k]), percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    one = known.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"), F.col("fine").alias("fa"))
    two = known.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"), F.col("fine").alias("fb"))
    sized = pairs.join(one.drop("pa", "fa"), "a").join(two.drop("pb", "fb"), "b")
    sized = sized.where(F.col("na") * 100 >= F.col("nb") * percent).where(F.col("nb") * 100 >= F.col("na") * percent)
    return sized.join(two, ["b", "nb"]).join(one, ["a", "na"]).select("a", "b", "na", "nb", "pa", "fa", "pb", "fb").mapInArrow(part, "a long, b long")


def _verified(pairs: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by the sets themselves; only the pairs' texts are read again."""
    def part(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                need = least_overlap(len(s), len(t), percent)
                keep.append(need <= min(len(s), len(t)) and len(np.intersect1d(s, t, assume_unique=True)) >= need)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = written(_full(documents.join(small(ids, "pair-ids"), "doc_id", "left_semi"), words), "full-sets")  # too many ids to be broadcast shuffle the texts
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("sb")), "b")
    found = written(both.select("a", "b", "sa", "sb").mapInArrow(part, "a long, b long").distinct(), "links")
    removed(sets)
    return found


def _tree_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """rows (sig, part, i, j, id, n, component, point, owners, block, firsts), sorted by sig, part, i, j -> pairs that a tree's bound allows.

    A pair whose sets name a common owner is left to the tree of the smallest one: both are in it, and its bound is the
    same; where all of that signature's sets are one component or only these two, the pair needs no tree. Of the trees for a second
    shingle, likewise, the smallest that both name gives it.
    """
    def pairs(sig: int, part: int, ids: np.ndarray, n: np.ndarray, comp: np.ndarray, block: np.ndarray, points: np.ndarray, owners: list[list[int]], firsts: list[list[int]], one: bool) -> Iterator[tuple[int, int]]:
        if len(ids) <= NODE:
            wanted = comp[:, None] != comp[None]
            if not one:
                wanted &= block[:, None] != block[None]
            found = zip(*(x.tolist() for x in within_node(points, n, wanted, percent)), strict=True)
        else:
            tree = RTree(points, n)
            found = ((k, int(m)) for k in range(len(ids)) for m in tree.search(points[k], int(n[k]), percent) if ids[k] < ids[m] and comp[k] != comp[m] and (one or block[k] != block[m]))
        for k, m in found:
            if min(set(owners[k]).intersection(owners[m]), default=sig) == sig and min(set(firsts[k]).intersection(firsts[m]), default=part) == part:
                yield int(min(ids[k], ids[m])), int(max(ids[k], ids[m]))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found: set[tuple[int, int]] = set()

        def searched(table: pa.Table) -> None:
            c = {x: table.column(x).to_numpy() for x in ("sig", "part", "i", "j", "id", "n", "component", "block")}
            points, owners, firsts = counts_of(table.column("point").to_pylist()), table.column("owners").to_pylist(), table.column("firsts").to_pylist()
            new = np.nonzero(np.any([np.diff(c[x]) != 0 for x in ("sig", "part", "i", "j")], axis=0))[0] + 1
            for a, b in zip([0, *new], [*new, len(points)], strict=True):
                if b - a > 1:
                    s = slice(a, b)
                    found.update(pairs(int(c["sig"][a]), int(c["part"][a]), c["id"][s], c["n"][s], c["component"][s], c["block"][s], points[s], owners[s], firsts[s], c["i"][a] == c["j"][a]))

        def out() -> pa.RecordBatch:
            x = np.array(sorted(found), np.int64).reshape(-1, 2)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            place = [table.column(x).to_numpy() for x in ("sig", "part", "i", "j")]
            whole = np.nonzero(np.any([x != x[-1] for x in place], axis=0))[0]
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                searched(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            if len(found) > 100_000:
                yield out()
        if held:
            searched(pa.Table.from_batches(held))
        yield out()

    return rows.select("sig", "part", "i", "j", "id", "n", "component", "point", "owners", "block", "firsts").mapInArrow(part, "a long, b long")


def links(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(members, components): doc_id, n, key, id of every row (id: the smallest doc_id with that set, or its own where there is no set), and id, component."""
    tables: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        tables.append(written(df, name))
        return tables[-1]

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = kept(_sets(texts, words, percent), "shingle-sets")
    often = scanned.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "bucket").limit(FREQUENT)
    last = np.array([r[0] for r in often.select("bucket").collect()], np.int64)  # at most FREQUENT numbers, for the order only
    members = scanned.where("n IS NOT NULL").select("doc_id", "n", "key")
    signed = kept(_signatures(scanned, last, percent), "signed")
    short = small(signed.where("sigs IS NULL").select("doc_id").distinct(), "short")  # of many frequent shingles
    whole = kept(_full(texts.join(short, "doc_id", "left_semi"), words).withColumnRenamed("id", "doc_id"), "short-sets")  # written, since two kernels in one stage are two workers a core
    whole = _signatures(whole, last, percent, "items")
    named = signed.where("sigs IS NOT NULL").unionByName(whole).groupBy("key").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("sigs", "beyond"), "doc_id").alias("s"))
    points = scanned.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("point").alias("point"), F.first("fine").alias("fine"))
    chosen = kept(named.join(points, "key").select("key", "id", "n", "point", "fine", "s.sigs", "s.beyond"), "signatures")
    each = chosen.select("id", F.explode("sigs").alias("sig"))
    shared = kept(each.groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("sets")).where("sets > 1"), "shared")
    rows = kept(each.join(shared, "sig").select("sig", "id", "least", "sets"), "shared-rows")
    stars = kept(rows.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    known = chosen.select("id", "n", "point", "fine")
    edges = _verified(kept(_starred(stars, known, percent), "star-pairs"), texts, words, percent)
    members = written(members.join(chosen.select("key", "id"), "key", "left").select("doc_id", "n", "key", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")).alias("id")), "members")
    several = members.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("doc_id", "a")
    edges = written(edges.unionByName(members.join(several, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()), "links")

    # a signature of two sets has no pair but its star; of the others, those in one component are done
    comp = connected_components(edges).withColumnRenamed("id", "node")
    rows = rows.where("sets > 2").select("sig", "id").join(comp, F.col("id") == F.col("node"), "left").select("sig", "id", F.coalesce("component", "id").alias("component"))
    rows = kept(rows, "rows-components")
    open_ = rows.groupBy("sig").agg(F.count("*").alias("sets"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2")
    open_ = kept(open_.select("sig", "sets"), "open")
    open_ = open_.withColumn("blocks", F.ceil(F.col("sets") / TREE).cast("int"))
    rest = rows.join(open_.where(F.col("blocks") <= BLOCKS).select("sig", "blocks"), "sig").withColumn("part", F.col("sig"))
    # of a much larger signature, linked sets share another shingle too, of one more each: there is a tree for both
    many = rows.join(open_.where(F.col("blocks") > BLOCKS).select("sig"), "sig").join(chosen.select("id", "sigs", "beyond"), "id")
    other = F.array_except(F.array_compact(F.array_append("sigs", F.col("beyond"))), F.array("sig")) if percent > 50 else F.array("sig")
    many = many.select("sig", "id", "component", F.transform(other, lambda x: F.xxhash64("sig", x)).alias("parts"))
    many = kept(many.select("sig", "id", "component", F.slice(F.array_sort("parts"), 1, OWNERS).alias("firsts"), F.explode("parts").alias("part")), "two-shingle-rows")
    parts = many.groupBy("sig", "part").agg(F.count("*").alias("sets"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2")
    many = many.join(kept(parts.select("sig", "part", F.ceil(F.col("sets") / TREE).cast("int").alias("blocks")), "open-parts"), ["sig", "part"])
    rest = rest.select("sig", "part", "id", "component", "blocks", F.array("sig").alias("firsts")).unionByName(many.select("sig", "part", "id", "component", "blocks", "firsts"))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("sig", "part", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "firsts").join(chosen.select("id", "n", "point", F.slice(F.array_sort("sigs"), 1, OWNERS).alias("owners")), "id")
    rest = rest.repartition("sig", "part", "i", "j").sortWithinPartitions("sig", "part", "i", "j")
    # repeats go before the join; Spark would push it below them
    more = kept(kept(_tree_pairs(rest, percent).distinct(), "tree-pairs").join(stars, ["a", "b"], "left_anti"), "new-pairs")
    edges = edges.unionByName(_verified(kept(_bounded(more, known, percent), "bounded-pairs"), texts, words, percent))
    found = connected_components(edges)
    removed(*tables)
    return members, found


def join(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+`, and a set is the distinct shingles of so many
    words; fewer words are one shingle; a null or empty text, or one without words, has none and is
    linked with nothing. Rows link when 100 * intersection >= percent * union. component_id is the smallest doc_id that links reach.
    Equal sets meet as one. Rows that share a doc_id are one node. A row with a null doc_id has no
    place among the links: its component is null. Other columns are ignored, and an empty table gives no rows.
    """
    members, comp = links(documents, words, percent)
    found = members.join(comp, "id", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_one(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, with all columns.

    Rows that share a doc_id are one document: they stay or go together. Documents without words, and
    rows with a null doc_id, all stay.
    """
    found = join(documents.select("doc_id", "text"), words, percent)
    gone = small(found.where("component_id < doc_id").select("doc_id").distinct(), "near-copies")
    return rows_as(documents).join(gone, F.col("doc.doc_id") == F.col("doc_id"), "left_anti").select("doc.*")
