"""N-gram Jaccard join by partitioning the universe of shingles.

Two sets with a similarity of 0.8 differ in at most H = floor((a + b) / 9) shingles. The universe of shingle hashes is
cut into segments; H differences damage at most H of them, so of any H + 1 that a document holds, one is the same in its
partner (pigeonhole). A document indexes H + 1 segments. Cost-based allocation says which: a sketch of bounded size
counts how often each occurs in the corpus, every document takes its H + 1 cheapest (threshold 0), in one order for all,
and leaves out the rest (threshold -1). Any order by content is exact: the first common segment in that order has at most
H before it, in either document. Sets of 4 to 8 shingles, where one difference is all there can be, index their whole
set and its one-deletion neighbourhood (threshold 1).

The universe is cut as finely as it can be, a segment for each shingle. Then a key's place in a document's order bounds
the difference of all pairs that first meet there: p keys before it in one and q in the other are p + q differences.
With coarser segments a difference may damage a segment of both, so that places say less: on the table check_h they left
1,735,138 different pairs in groups (22.3 M with repeats), where single shingles leave 862,730 (4.6 M), most of them links.

Equal sets are one class from the start. Classes with a common key are not paired with each other: of all groups that it
is in, a class takes one partner, the most ordinary class that heads one of them (with the most frequent shingles: the
text that near copies were made of, rather than one of them). What then lies in one component needs no further pairs.
This goes on with new heads for as long as most pairs are links; at last the members of a group outside its head's
component are paired with all members of other components that sizes and places allow. So a group of n near copies costs
about n verifications and no link between different components is lost. Pairs are first held against parity bitmaps of
the sets: two sets that differ in d shingles have bitmaps that differ in d bits at most, so pairs beyond the bound go
without their sets being moved. The others are verified on whole shingle sets.

A key that very many classes share is dealt over several tasks (its frequency is estimated from one class in SAMPLE, for
this purpose only); the head of the whole is then the best of its parts' heads.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import discard, small_batches, written
from quarry.llm.links import bitmap, components, hit, place
from quarry.llm.words import U, Words, mixed, runs

SHINGLE = 5
#: The similarity is at least 80 in 100, on which the sizes of bands and prefixes rest.
NEED, OF = 80, 100
#: Most binary digits of the number of the sketch's counters, and its parts.
MAX_CELL_BITS, CELL_ROWS = 24, 16
#: What a task counts up to in a cell.
MOST = 65_535
#: Most bits of a set's parity signature.
MAX_SIGNATURE = 1 << 17
#: Rows of keys that a task holds, about. One class in SAMPLE tells which keys are in more rows than HOT or a part of 1 / HOT_KEYS of all; the table of these keys has about HOT_KEYS rows at most.
TASK_ROWS, SAMPLE, HOT, HOT_KEYS = 500_000, 64, 1024, 500_000
#: Sizes are dealt into buckets of a factor of 2 ** (1 / STEP) for the last joins.
STEP = 4
#: Classes that a task remembers so as not to emit a class twice, and rows in a batch of output.
SEEN = 200_000


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Number and sorted distinct shingle hashes of each text; under five words, the whole sequence is the only one."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    grams = runs(hashes, SHINGLE)
    for i in range(len(column)):
        a, b = int(words.of[i]), int(words.of[i + 1])
        if b - a >= SHINGLE:
            s = np.sort(grams[a : b - SHINGLE + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            yield i, s[keep]
        elif b > a:
            yield i, runs(hashes[a:b], b - a)
        else:
            yield i, grams[:0]


class Seen:
    """Which classes a task has met of late, so as to emit each once a task or little more; of bounded size."""

    def __init__(self) -> None:
        self.classes: set[int] = set()

    def new(self, cls: int) -> bool:
        if cls in self.classes:
            return False
        if len(self.classes) >= SEEN:
            self.classes.clear()
        self.classes.add(cls)
        return True


def class_of(s: np.ndarray) -> int:
    """A hash of a whole set."""
    total = np.add.reduce(mixed(s), keepdims=True)
    return int(mixed(total ^ mixed(np.array([len(s)], U))).view(np.int64)[0])


def segments(s: np.ndarray) -> np.ndarray:
    """Keys of a set's segments."""
    return mixed(s ^ U(0xA24BAED4963EE407))


def deletions(s: np.ndarray) -> np.ndarray:
    """Keys of a small set and of its one-deletion neighbourhood."""
    m = mixed(s)
    total = np.add.reduce(m)
    return mixed(np.append(total - m, total) ^ U(0x8CB92BA72F3D8DD7))


def keys_of(s: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """The keys of the segments that a set of 8 or more shingles indexes, the cheapest by the sketch's costs first."""
    keys = segments(s)
    order = np.argsort((costs[keys >> _shift(costs)].astype(U) << U(56)) | (keys >> U(8)))
    return keys[order[: len(s) // 4 + 1]]


def _shift(costs: np.ndarray) -> np.uint64:
    return U(64 - (len(costs).bit_length() - 1))


def rareness(s: np.ndarray, costs: np.ndarray) -> int:
    """0 to 255: the lower, the more frequent the set's shingles are in the corpus."""
    return 255 - int(min(255.0, 6 * costs[segments(s) >> _shift(costs)].mean()))


def signature(s: np.ndarray) -> bytes:
    """Parity bitmap of a set: bit i is the parity of how many shingles hash to i; half as many bits again as shingles."""
    bits = min(MAX_SIGNATURE, max(64, 1 << (3 * len(s) // 2).bit_length()))
    odd = np.bincount((mixed(s ^ U(0x3C6EF372FE94F82B)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def may_link(n: int, x: bytes, m: int, y: bytes) -> bool:
    """Whether sizes and parity bitmaps allow two sets a similarity of 0.8."""
    if OF * min(n, m) < NEED * max(n, m):
        return False
    p, q = np.frombuffer(x, U), np.frombuffer(y, U)
    if len(p) > len(q):
        p, q = q, p
    if len(p) < len(q):  # the bitmap of half the bits is the larger one's halves, added
        q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), 0)
    return int(np.bitwise_count(p ^ q).sum()) <= (n + m) * (OF - NEED) // (OF + NEED)


def _classes(docs: DataFrame, id_col: str, text_col: str, cell_bits: int) -> DataFrame:
    """A row for each document (kind 0: id, th, n, cls, and once a task at least each class's signature) and the sketch's partial counts (kind 1: part, data)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, shift = np.zeros(1 << cell_bits, np.uint16), Seen(), U(64 - cell_bits)
        for batch in batches:
            n, cls, cells, data = [], [], [], []
            for _, s in shingle_sets(batch.column(2)):
                n.append(len(s))
                cls.append(class_of(s) if len(s) else None)
                data.append(None)
                if len(s) >= 4 and seen.new(cls[-1]):
                    data[-1] = signature(s)
                    cells.append(segments(s) >> shift)
            if cells:
                at, more = np.unique(np.concatenate(cells), return_counts=True)
                counts[at] = np.minimum(counts[at] + more, MOST)
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.nulls(k, pa.int32()), pa.array(data, pa.binary())], names)
        if counts.any():
            parts = [zlib.compress(p.astype("<u2"), 1) for p in np.split(counts, CELL_ROWS)]
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), *(pa.nulls(k, pa.int64()) for _ in range(4)), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names)

    names = ["kind", "id", "th", "n", "cls", "part", "data"]
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col)).mapInArrow(rows, "kind int, id long, th long, n long, cls long, part int, data binary")


def _costs(classes: DataFrame, cell_bits: int) -> np.ndarray:
    """The sketch as one byte a counter, twice the binary logarithm of its count: 16 MB on the driver at most."""

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                more = np.frombuffer(zlib.decompress(counts.as_buffer()), "<u2")
                total[part] = total[part] + more if part in total else more.astype(np.uint64)
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(total), pa.int32()), "cost": pa.array([(2 * np.log2(v + 1.0)).astype(np.uint8).tobytes() for v in total.values()], pa.binary())})

    out = np.zeros((CELL_ROWS, (1 << cell_bits) // CELL_ROWS), np.uint8)
    for r in classes.filter("kind = 1").select("part", "data").repartition(CELL_ROWS, "part").mapInArrow(summed, "part int, cost binary").toLocalIterator():
        out[r["part"]] = np.frombuffer(bytes(r["cost"]), np.uint8)
    return out.ravel()


def _keys(docs: DataFrame, text_col: str, costs: np.ndarray) -> DataFrame:
    """(cls, n, rare, placed, keys): the keys that a class indexes, in order where placed; a class comes once a task at least."""
    shared = docs.sparkSession.sparkContext.broadcast(costs)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            cls, n, rare, placed, keys = [], [], [], [], []
            for _, s in shingle_sets(batch.column(0)):
                if len(s) >= 4 and seen.new(c := class_of(s)):
                    for few in ([True] if len(s) < 8 else [True, False] if len(s) == 8 else [False]):
                        cls.append(c)
                        n.append(len(s))
                        rare.append(rareness(s, shared.value))
                        placed.append(not few)
                        keys.append(deletions(s) if few else keys_of(s, shared.value))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, keys)])
            columns = [pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(rare, pa.int16()), pa.array(placed, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "n", "rare", "placed", "keys"])

    return docs.select(F.col(text_col)).mapInArrow(rows, "cls long, n int, rare short, placed boolean, keys array<long>")


def _partnered(group: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which rows of groups (numbered from 0, in order) may have a partner in theirs.

    By places, sets of n shingles have partners of up to (10 n - 18 pos) / 8; so a row needs another one that reaches its
    size, and one whose size it reaches.
    """
    if not len(group):
        return np.zeros(0, bool)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    reach = 10 * n - 18 * pos

    def others(x: np.ndarray) -> np.ndarray:
        """The largest x of the other rows in a group; the smallest number where there is none."""
        order = np.lexsort((-x, group))
        low = np.int64(np.iinfo(np.int64).min)
        top = x[order[begin]]
        more = np.append(begin[1:], len(x)) - begin > 1
        second = np.where(more, x[order[np.minimum(begin + 1, len(x) - 1)]], low)
        best = np.zeros(len(x), bool)
        best[order[begin]] = True
        return np.where(best, second[group], top[group])

    return (others(reach) >= 8 * n) & (8 * -others(-n) <= reach) & (others(n) > 0)


def _groups(lists: DataFrame) -> DataFrame:
    """(key, cls, n, pos, rare, head): members of the groups of two or more classes with a common key; head is the most ordinary one (rare, cls, n, pos).

    A task holds the keys of a range of hashes, of bounded size; a hot key is dealt over several by its classes.
    """
    total = lists.agg(F.sum(F.size("keys"))).first()[0] or 0
    floor = max(HOT, total // HOT_KEYS)
    sampled = lists.filter(F.pmod("cls", F.lit(SAMPLE)) == 0).select(F.explode("keys").alias("key")).groupBy("key").count()
    hot = sampled.filter(F.col("count") * SAMPLE >= floor).select("key", F.ceil(F.col("count") * SAMPLE / floor).alias("parts"))
    hot = written(hot, "hot-keys")
    rows = lists.select("cls", "n", "rare", "placed", F.posexplode("keys").alias("pos", "key")).join(F.broadcast(hot), "key", "left")
    rows = rows.select("key", F.coalesce(F.pmod("cls", "parts"), F.lit(-1)).alias("part"), "cls", "n", F.when(F.col("placed"), F.col("pos")).otherwise(0).alias("pos"), "rare")

    def grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [tuple(b.column(i).to_numpy() for i in range(6)) for b in batches if b.num_rows]
        if not got:
            return
        key, part, cls, n, pos, rare = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.lexsort((pos, cls, rare, part, key))
        key, part, cls = key[order], part[order], cls[order]
        new = np.ones(len(key), bool)  # a group begins
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        again = np.zeros(len(key), bool)  # a class that several tasks emitted
        again[1:] = ~new[1:] & (cls[1:] == cls[:-1])
        order, key, part, cls, new = order[~again], key[~again], part[~again], cls[~again], new[~again]
        n, pos, rare = n[order], pos[order], rare[order]
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        keep = np.repeat(size > 1, size) | (part >= 0)
        keep[keep] = _partnered(np.cumsum(new[keep]) - 1, n[keep].astype(np.int64), pos[keep].astype(np.int64)) | (part[keep] >= 0)
        key, part, cls, n, pos, rare = key[keep], part[keep], cls[keep], n[keep], pos[keep], rare[keep]
        if not len(key):
            return
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        size = np.diff(np.append(first, len(key)))
        take = np.flatnonzero(np.repeat((size > 1) | (part[first] >= 0), size))
        head = np.repeat(first, size)[take]
        for i in range(0, len(take), 50_000):
            t, h = take[i : i + 50_000], head[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[t], part[t], cls[t], n[t], pos[t], rare[t], rare[h], cls[h], n[h], pos[h])], ["key", "part", "cls", "n", "pos", "rare", "h_rare", "h_cls", "h_n", "h_pos"])

    schema = "key long, part long, cls long, n int, pos int, rare short, h_rare short, h_cls long, h_n int, h_pos int"
    out = rows.repartition(max(16, total // TASK_ROWS), "key", "part").mapInArrow(grouped, schema)
    out = written(out.select("key", "part", "cls", "n", "pos", "rare", F.struct(F.col("h_rare").alias("rare"), F.col("h_cls").alias("cls"), F.col("h_n").alias("n"), F.col("h_pos").alias("pos")).alias("head")), "groups")
    whole = F.broadcast(out.filter("part >= 0").groupBy("key").agg(F.min("head").alias("best")))
    return out.join(whole, "key", "left").select("key", "cls", "n", "pos", "rare", F.coalesce("best", "head").alias("head"))


def _sets(docs: DataFrame, id_col: str, text_col: str, ids: np.ndarray) -> DataFrame:
    """(cls, shingles) of the documents whose ids are in a bitmap; a class may come several times."""
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            batch = batch.filter(pa.array(hit(shared.value, batch.column(0).to_numpy())))
            cls, sets = [], []
            for _, s in shingle_sets(batch.column(1)):
                if len(s) >= 4 and seen.new(c := class_of(s)):
                    cls.append(c)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], ["cls", "shingles"])

    found = docs.select(place(F.coalesce(F.col(id_col).cast("long"), F.lit(-1))).alias("at"), F.col(text_col)).mapInArrow(rows, "cls long, shingles binary")
    return found


def _allowed(n: Column, p: Column, m: Column, q: Column) -> Column:
    """Whether sets of n and m shingles can be linked if the first common key has p keys before it in one and q in the other."""
    most = F.floor((n + m) * (OF - NEED) / (OF + NEED))
    return (OF * F.least(n, m) >= NEED * F.greatest(n, m)) & (p + q <= most) & (F.greatest(2 * p + m - n, 2 * q + n - m) <= most)


def _signatures(rows: DataFrame) -> DataFrame:
    """(cls, n, data), one row a class: each task that met a class emitted it, so a text in many partitions comes in many rows."""
    return rows.filter("data is not null").select("cls", "n", "data").dropDuplicates(["cls"])


def _possible(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and signatures (cls, n, sig) allow to link."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x, m, y = (batch.column(i) for i in range(2, 6))
            keep = [may_link(*v) for v in zip(n.to_pylist(), (v.as_buffer() for v in x), m.to_pylist(), (v.as_buffer() for v in y), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, n, sig: signatures.select(F.col("cls").alias(c), F.col("n").alias(n), F.col("data").alias(sig))
    return pairs.join(side("b", "m", "y"), "b").join(side("a", "n", "x"), "a").select("a", "b", "n", "x", "m", "y").mapInArrow(rows, "a long, b long").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) where 100 times the intersection is 80 times the union at least, on whole sets."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                near.append(OF * both >= NEED * (len(s) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    right = pairs.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("t")), "b")
    both = right.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("s")), "a")
    return both.select("a", "b", "s", "t").mapInArrow(rows, "a long, b long")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members of the groups that still span several components, with the components of cls (root) and of the head (head_root)."""

    def rooted(frame: DataFrame, cls: str, root: str) -> DataFrame:
        found = roots.select(F.col("node").alias("__cls"), F.col("root").alias("__root"))
        return frame.join(found, F.col(cls) == F.col("__cls"), "left").withColumn(root, F.coalesce("__root", cls)).drop("__cls", "__root")

    members = rooted(members, "cls", "root")
    spans = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    return rooted(members.join(spans, "key", "left_semi"), "head.cls", "head_root")


def _new_heads(members: DataFrame) -> DataFrame:
    """The members outside their head's component, with the most ordinary of them as their new head."""
    left = members.filter("root <> head_root")
    best = left.groupBy("key").agg(F.min(F.struct("rare", "cls", "n", "pos", "root")).alias("head"))
    return left.drop("head", "head_root").join(best, "key").withColumn("head_root", F.col("head.root"))


def _headed(members: DataFrame) -> DataFrame:
    """(a, b): for each class one partner, the most ordinary head of its groups that may be linked with it."""
    allowed = members.filter((F.col("root") != F.col("head_root")) & _allowed(F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos")))
    best = allowed.groupBy("cls").agg(F.min(F.struct("head.rare", F.col("head.cls").alias("b"))).alias("x"))
    return best.select(F.least("cls", "x.b").alias("a"), F.greatest("cls", "x.b").alias("b")).distinct()


def _rest(members: DataFrame) -> DataFrame:
    """(a, b): the members of each group outside its head's component with all that may be linked with them.

    Both sides are dealt by key and size; a member meets the buckets of the sizes that its place allows.
    """
    bucket = lambda n: F.floor(F.log2(n) * STEP)
    n, p = F.col("n"), F.col("pos")
    few, many = NEED / OF * n, OF / NEED * n - (OF + NEED) / NEED * p  # 2 p + m - n <= (n + m) / 9, solved for m
    left = members.filter((F.col("root") != F.col("head_root")) & (many >= few)).select("key", F.explode(F.sequence(bucket(F.floor(few)), bucket(F.ceil(many)))).alias("bucket"), F.col("cls").alias("a"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), F.col("root").alias("a_root"))
    right = members.select("key", bucket(n).alias("bucket"), "cls", "n", "pos", "root")
    found = left.join(right, ["key", "bucket"]).filter((F.col("root") != F.col("a_root")) & _allowed(F.col("a_n"), F.col("a_pos"), n, p))
    return found.select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct()


def _linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, n, root, component_id) for each document; th is a hash of the text, root a class or null."""
    small_batches(docs.sparkSession)
    # About a counter for each word, up to a fixed size.
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    cell_bits = min(MAX_CELL_BITS, max(12, (size // 6).bit_length()))
    classes = written(_classes(docs, id_col, text_col, cell_bits), "classes")
    rows = classes.filter("kind = 0")
    lists = written(_keys(docs, text_col, _costs(classes, cell_bits)), "keys")
    members = written(_groups(lists).withColumn("root", F.col("cls")).withColumn("head_root", F.col("head.cls")), "members")
    discard(lists)
    of = rows.filter("n >= 4").groupBy("cls").agg(F.min("id").alias("id"))
    signatures = _signatures(rows)

    def near(asked: DataFrame) -> tuple[int, DataFrame | None]:
        """How many pairs there are, and the links among them; None if there are none."""
        asked = written(asked, "asked")
        pairs = asked.count()
        if not pairs:
            return 0, None
        asked = written(_possible(asked, signatures), "possible")
        nodes = asked.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        ids = bitmap(nodes.join(of, "cls").select(F.coalesce("id", F.lit(-1)).alias("id")), "id")
        # One exchange of the sets by class serves both sides of the pairs.
        return pairs, written(_verified(asked, _sets(docs, id_col, text_col, ids).dropDuplicates(["cls"])), "verified")

    roots, last, asked = None, False, _headed(members)
    while True:
        pairs, links = near(asked)
        found = links.count() if links is not None else 0
        if found:
            if roots is not None:
                links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
            roots = written(components(links), "roots")
        if last:
            break
        if found:
            members = written(_open(members, roots), "members")
        last = 2 * found < pairs or not pairs
        asked = _rest(members) if last else _headed(_new_heads(members))
    ids = rows.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("id"))
    if roots is None:
        of_class = ids.select("cls", F.col("cls").alias("root"), F.col("id").alias("component_id"))
    else:
        least = roots.join(ids, F.col("node") == F.col("cls")).groupBy("root").agg(F.min("id").alias("component_id"))
        found = roots.join(least, "root").select(F.col("node").alias("cls"), "root", "component_id", F.lit(True).alias("found"))
        of_class = ids.join(found, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), F.when(F.col("found"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    some = rows.join(of_class, "cls").select("id", "th", "n", "root", "component_id")
    none = rows.filter("cls is null").select("id", "th", "n", F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id"))
    return some.unionByName(none)


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, n_shingles and component_id, the smallest id that links reach.

    Texts are read from their source again for each pass and never shuffled. Null, empty and blank texts have no shingles
    and are linked with nothing; component_id is then their own id. Repeated rows and equal texts have equal components.
    A null id never is a component's smallest unless all its ids are null. Columns but the two are not read.
    """
    return _linked(docs, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that with the smallest id (a null id only where all are null).

    Of equal ids in a component, the text with the smallest hash stays; of rows with equal id and text, one. Documents
    without words all stay. Texts are shuffled only where an id and its text repeat.
    """
    found = written(_linked(docs, id_col, text_col).filter("n > 0"), "linked")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("x"), F.count("*").alias("n")).select("x.*")
    again = found.groupBy("id", "th").count().filter("count > 1").select("id", "th", F.lit(True).alias("again"))
    best = best.join(again, best["id"].eqNullSafe(again["id"]) & (best["th"] == again["th"]), "left").select(F.coalesce(best["id"], F.lit(-1)).alias("__id"), best["id"].isNull().alias("__none"), best["th"].alias("__th"), F.coalesce("again", F.lit(False)).alias("__again"))
    best = written(best, "representatives")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), "__none": F.col(id_col).isNull(), "__th": F.xxhash64(text_col)})
    blank = docs.filter(~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    key = ["__id", "__none", "__th"]
    out = keyed.join(best.filter("not __again"), key, "left_semi").select(*columns)
    twice = best.filter("__again")
    if not twice.isEmpty():
        out = out.unionByName(keyed.join(twice, key, "left_semi").dropDuplicates(key).select(*columns))
    return out.unionByName(blank)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents."""
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
