"""Near-duplicate documents: DartMinHash signatures, banded joining, exact checks.

A document is the weighted set of its shingles of five words (lower-cased ASCII
letters, digits and non-ASCII characters make words; a text of one to four words
is one shingle), the weight being the number of occurrences.  Two documents are
linked when the weighted Jaccard similarity of these sets is THRESHOLD or more;
classes are the connected components of the links.

Signatures.  Each shingle owns the region from 0 to its weight on one axis, cut
into cells [0, 1), [1, 2), [2, 4), ...  Darts that depend on the shingle and the
cell alone arrive in a cell in order of rank, at a rate of the cell's width; darts
beyond the weight miss.  A dart falls on one of K coordinates, and each
coordinate keeps its earliest dart.  Darts are thrown up to a rank at which all
coordinates are expected to have one, about K ln K in all however many shingles
there are, and further if one is empty.  Two signatures agree in a coordinate
with the probability of the similarity.

Joining.  Signatures are cut into BANDS bands of ROWS; documents that agree in a
band share a bucket.  At the threshold a pair shares no bucket with probability
(1 - 0.8**ROWS)**BANDS, below 1e-4.  Texts with the same words are one node of
the following, whatever their number.  The centre of a bucket is its member that
meets most others in all its buckets (ties: the least node), which lies near the
middle of a group of copies; every other member is compared with it by the exact
similarity, and the links so found are joined to components.

A node is open around a centre C if it is in another component than C.  Its links
to other members are looked for by edits: the shingle occurrences that are in one
of the two, node and C, only.  Nodes N, M of sizes n, m with dN, dM edits that share
c of them differ in dN + dM - 2c, and a similarity of 0.8 means (n + m) / 9 at most,
so c >= (dN + dM - (n + m) / 9) / 2, and c >= 1 if N is open.  A linked pair of which
none is open is in one component already.  Edits of a node are ordered by how many
nodes have them, rarest first; the first edit that a linked pair shares has at most
d - c edits before it on either side.  How far that goes depends on the other's
number of edits, so a node is placed at an edit once for each class of such numbers
(of ratio 1 + 1 / CLASSES) that leaves a link possible there, and only rows of
matching classes meet: an equality join on centre, edit and both classes.  Pairs
found are compared like the others.  This finds every link of an open node, and
nothing is gathered, expanded into all its pairs or capped.  A text gives a number
of rows in proportion to its length.

Keys that may hold many rows (bucket, centre, edit, text) are split: those above a
bound are at most common.HOT_KEYS, and only their keys are broadcast.

Null and empty texts have no shingles: texts without words are alike only if
they are equal (null counts as empty).  Very long texts are taken whole.  Rows may
repeat ids: each row is a document, and among equal ids one row is kept.  An empty
table gives an empty result.  Other columns, whatever their names, are kept by
deduplicate() and ignored otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components
from .decontaminate import _TO_WORDS

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 7, 40
K = ROWS * BANDS
#: Classes of numbers of edits: each is wider than the one before by 1 / CLASSES.
CLASSES = 2
#: Edits of pairs that a Python worker holds at once, about.
EDIT_BYTES = 4 << 20
#: Ids that are sent to all executors at most; beyond that they are joined by a shuffle.
BROADCAST_IDS = 500_000

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: A random number for each byte at each place (modulo 64) of a word.
_PLACES = np.random.default_rng(5).integers(0, 1 << 64, (64, 256), np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_TO_WORDS), np.uint8)
    inside = raw != 32
    if not inside.any():
        return np.empty(0, np.uint64)
    at = np.flatnonzero(inside)
    first = np.empty(len(at), bool)
    first[0], first[1:] = True, np.diff(at) > 1
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    values = _PLACES[place & 63, raw[at]]
    if lengths.max() > 64:
        values = values * (np.uint64(2) * (place >> 6).astype(np.uint64) + np.uint64(1))
    return _mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64))


def shingles(words: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit hashes, ascending) and their weights."""
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n = min(n, len(words))
    key = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        key = key * _C1 + words[i : len(words) - n + 1 + i]
    return np.unique(_mix(key), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of least weights over sum of greatest; 0 if either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _throw(ids: np.ndarray, weights: np.ndarray, limit: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rank, coordinate and identity of all darts up to the rank `limit`."""
    ranks, places, names = [], [], []
    low, cell = 0.0, 0
    while True:
        width = max(low, 1.0)
        own = ids[weights > low]
        if not len(own):
            break
        top = weights[weights > low]
        seed = _mix(own + np.uint64((cell + 1) * int(_C3) % (1 << 64)))
        rank = np.zeros(len(own))
        done = 0
        while len(seed):
            step = max(1, math.ceil(limit * width))
            number = np.arange(done, done + step, dtype=np.uint64) + np.uint64(1)
            darts = _mix(seed[:, None] + number[None, :] * _C1)
            r = rank[:, None] + np.cumsum(-np.log(_uniform(darts)), 1) / width
            hit = (r <= limit) & (low + width * _uniform(_mix(darts ^ _C2)) < top[:, None])
            d = darts[hit]
            ranks.append(r[hit])
            places.append((_mix(d + _C3) % np.uint64(k)).astype(np.int64))
            names.append(d)
            more = r[:, -1] <= limit
            seed, rank, top = seed[more], r[more, -1], top[more]
            done += step
        low, cell = low + width, cell + 1
    return np.concatenate(ranks), np.concatenate(places), np.concatenate(names)


def signature(ids: np.ndarray, weights: np.ndarray, k: int = K) -> np.ndarray:
    """The earliest dart of each coordinate; needs at least one shingle."""
    limit = (k * math.log(k) + 2 * k) / float(weights.sum())
    while True:
        rank, place, name = _throw(ids, weights.astype(np.float64), limit, k)
        if len(rank) >= k and len(np.unique(place)) == k:
            break
        limit *= 2
    out = np.empty(k, np.uint64)
    order = np.argsort(-rank, kind="stable")
    out[place[order]] = name[order]
    return out


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T:
        key = _mix(key * _C1 + column)
    return key


_MARK = T.StructType([T.StructField("same", T.StringType()), T.StructField("keys", T.ArrayType(T.LongType()))])


def marks(texts: list[str]) -> list[dict]:
    """For each text what texts with the same words share, and its buckets."""
    out = []
    for text in texts:
        words = word_hashes(text)
        if not len(words):
            out.append({"same": "t" + xxhash.xxh128_hexdigest(text.encode("utf-8", "surrogatepass")), "keys": []})
            continue
        keys = bucket_keys(signature(*shingles(words)))
        out.append({"same": "w" + xxhash.xxh128_hexdigest(words.tobytes()), "keys": keys.view(np.int64).tolist()})
    return out


def _few(ids: DataFrame) -> DataFrame:
    """Broadcast if its size is known to be small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _texts_of(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of the nodes of pairs (a, b)."""
    ids = common.stored(pairs.select("a").union(pairs.select("b")).distinct().toDF("node"), "pair-ids")
    return common.stored(texts.join(_few(ids), "node", "left_semi"), "pair-texts")


def _with_texts(pairs: DataFrame, needed: DataFrame) -> DataFrame:
    """pairs (a, b, more) with both texts; a may be a centre of very many pairs."""
    rows = pairs.join(needed.toDF("b", "text_b"), "b")
    return common.salted_join(rows, needed.toDF("a", "text_a"), "a", "b", common.hot_keys(pairs, "a"))


class _Shingles:
    """Shingles by node, of the nodes met last."""

    def __init__(self) -> None:
        self.known: dict[int, tuple] = {}

    def of(self, node: int, text: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        if node not in self.known:
            while len(self.known) >= 64:
                self.known.pop(next(iter(self.known)))
            self.known[node] = shingles(word_hashes(text.as_py()))
        return self.known[node]


def occurrences(found: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A weighted set as a plain one: each occurrence of a shingle is an element."""
    ids, counts = found
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return _mix(np.repeat(ids, counts) + number.astype(np.uint64) * _C2)


def compared(batch: pa.RecordBatch, own: _Shingles, with_edits: bool) -> Iterator[pa.RecordBatch]:
    """The rows of _compared() for a batch a, b, text_a, text_b, in parts of about
    EDIT_BYTES of edits; texts become Python's one by one."""
    a, b = batch.column(0), batch.column(1)
    names = ["a", "b", "similarity"] + (["size", "centre_size", "edits"] if with_edits else [])
    begin, held = 0, 0
    found, sizes, around, edits = [], [], [], []
    for at in range(len(batch)):
        x, y = own.of(a[at].as_py(), batch.column(2)[at]), own.of(b[at].as_py(), batch.column(3)[at])
        found.append(similarity(x, y))
        if with_edits:
            x, y = occurrences(x), occurrences(y)
            around.append(len(x))
            sizes.append(len(y))
            edits.append(np.setxor1d(x, y, assume_unique=True).view(np.int64))
            held += edits[-1].nbytes
        if held > EDIT_BYTES or at + 1 == len(batch):
            columns = [a.slice(begin, len(found)), b.slice(begin, len(found)), pa.array(found, pa.float64())]
            columns += [pa.array(sizes, pa.int32()), pa.array(around, pa.int32()), pa.array(edits, pa.list_(pa.int64()))] if with_edits else []
            yield pa.RecordBatch.from_arrays(columns, names)
            begin, held = at + 1, 0
            found, sizes, around, edits = [], [], [], []


def _compared(pairs: DataFrame, needed: DataFrame, with_edits: bool) -> DataFrame:
    """a, b, similarity of every pair (a, b) of nodes and, if wanted, size (of b),
    centre_size (of a) and edits; both texts are brought together once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Shingles()
        for batch in batches:
            yield from compared(batch, own, with_edits)

    rows = _with_texts(pairs, needed).select("a", "b", "text_a", "text_b")
    return common.stored(rows.mapInArrow(compare, "a long, b long, similarity double" + (", size int, centre_size int, edits array<long>" if with_edits else "")), "similarities")


def class_of(d: int) -> int:
    """The class of a number of edits, at least 1."""
    k = int(math.log(d) / math.log1p(1 / CLASSES))
    while class_start(k + 1) <= d:
        k += 1
    while class_start(k) > d:
        k -= 1
    return k


def class_start(k: int) -> int:
    """The least number of edits in class k."""
    return math.ceil((1 + 1 / CLASSES) ** k - 1e-9)


def places(d: int, size: int, centre_size: int) -> list[tuple[int, int]]:
    """(class, places) for each class of the number of edits that a linked node may
    have: a first shared edit lies among so many of the d edits, rarest first.

    The other has at most 5 / 4 of the size, and the centre's size and its edits."""
    out, k = [], class_of(max(1, d - size // 4 - 1))
    while True:
        low, high = class_start(k), class_start(k + 1) - 1
        shared = max(1, math.ceil((d + low - (size + min(1.25 * size, centre_size + low)) / 9) / 2 - 1e-9))
        if shared > d or low > d + size / 4:
            return out
        if low <= high and shared <= high and high >= d - size / 4:
            out.append((k, d - shared + 1))
        k += 1


_PLACED = "centre long, edit long, own int, other int, node long, open boolean, root long, size int, d int, place int"


def _placed(sets: DataFrame) -> DataFrame:
    """Rows of _PLACED from centre, node, open, root, size, centre_size, d and
    order: the edits that others have too, rarest first, with a mark on those that
    an open node has."""
    names = [f.split()[0] for f in _PLACED.split(", ")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("centre", "node", "open", "root", "size", "centre_size", "d")}
            lists = batch.column("order")
            inner, ends = lists.flatten(), lists.value_lengths().to_numpy().cumsum()
            edits, asked = inner.field("edit").to_numpy(), inner.field("asked").to_numpy(zero_copy_only=False)
            which, at, own, other, where = [], [], [], [], []
            for i, (d, size, around, end) in enumerate(zip(of["d"].tolist(), of["size"].tolist(), of["centre_size"].tolist(), ends.tolist())):
                begin = int(ends[i - 1]) if i else 0
                known = begin + np.flatnonzero(asked[begin:end])
                place_of = known - begin + d - (end - begin)  # edits of this node alone come first
                mine = class_of(d)
                for k, many in places(d, size, around):
                    n = int(np.searchsorted(place_of, many))
                    if n:
                        which.append(np.full(n, i))
                        at.append(known[:n])
                        where.append(place_of[:n].astype(np.int32))
                        own.append(np.full(n, mine, np.int32))
                        other.append(np.full(n, k, np.int32))
            if which:
                w = np.concatenate(which)
                columns = [of["centre"][w], edits[np.concatenate(at)], np.concatenate(own), np.concatenate(other), of["node"][w], of["open"][w], of["root"][w], of["size"][w], of["d"][w], np.concatenate(where)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return common.stored(sets.mapInArrow(place, _PLACED), "placed-edits")


def _edit_links(edits: DataFrame) -> DataFrame:
    """a, b: possible links of an open node to a node of another component.  edits:
    centre, node, open, root, size, centre_size, edits."""
    each = edits.select("centre", "node", "open", F.explode("edits").alias("edit"))
    shared = each.groupBy("centre", "edit").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("asked")).where("n > 1")
    shared = common.stored(shared, "shared-edits")
    known = common.hot_join(each.drop("open"), shared, ["centre", "edit"], edits.agg(F.sum(F.size("edits"))).first()[0] or 0)
    order = known.groupBy("centre", "node").agg(F.array_sort(F.collect_list(F.struct("n", "edit", "asked"))).alias("order"))
    sets = edits.withColumn("d", F.size("edits")).drop("edits").join(order, ["centre", "node"])
    rows = _placed(sets)
    open_, rest = rows.where("open").alias("x"), rows.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{e}") for c, e in (("centre", "centre"), ("edit", "edit"), ("own", "other"), ("other", "own"))]
    needed = (F.col("x.d") + F.col("y.d") - (F.col("x.size") + F.col("y.size")) * ((1 - THRESHOLD) / (1 + THRESHOLD))) / 2 - 1e-6
    possible = F.least(F.col("x.d") - F.col("x.place"), F.col("y.d") - F.col("y.place")) >= needed
    once = ~F.col("y.open") | (F.col("x.node") < F.col("y.node"))
    found = open_.join(rest, [*same, F.col("x.root") != F.col("y.root"), once, possible])
    return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _starred(nodes: DataFrame) -> DataFrame:
    """a, b: centre and member of every bucket, each pair once.  nodes: node, keys."""
    spread = nodes.select("node", F.explode("keys").alias("key"))
    total = (nodes.count() * BANDS) or 1
    buckets = common.stored(spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    met = common.hot_join(spread, buckets, ["key"], total).groupBy("node").agg(F.sum("n").alias("met"), F.collect_list("key").alias("keys"))
    met = common.stored(met, "met").select("node", "met", F.explode("keys").alias("key"))
    centres = met.groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("first"))).alias("c"), F.count(F.lit(1)).alias("n"))
    centres = common.stored(centres.select("key", (-F.col("c.first")).alias("centre"), "n"), "centres")
    members = common.hot_join(met.select("node", "key"), centres, ["key"], total).where("node <> centre")
    return common.stored(members.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs")


def _roots(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, root of the components of all links, for nodes that are no root.  nodes:
    node, keys."""
    pairs = _starred(nodes)
    needed = _texts_of(pairs, texts)
    compared = _compared(pairs, needed, True)
    roots = components(compared.where(F.col("similarity") >= THRESHOLD).select("a", "b"))
    of_centre = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(roots.toDF("a", "centre_root"), "a", "left")
    around = common.hot_join(pairs, common.stored(of_centre, "star-centres"), ["a"], pairs.count()).join(roots.toDF("b", "root"), "b", "left")
    around = around.select("a", "b", F.coalesce("root", "b").alias("root"), F.coalesce("centre_root", "a").alias("centre_root"), "n")
    around = common.stored(around.select("a", "b", "root", (F.col("root") != F.col("centre_root")).alias("open"), "n"), "around")
    opened = common.stored(around.groupBy("a").agg(F.max("open").alias("some"), F.count(F.lit(1)).alias("n")).where("some").select("a", "n"), "open-centres")
    if not opened.take(1):
        return roots
    around = common.hot_join(around.drop("n"), opened, ["a"], pairs.count()).drop("n")
    edits = compared.drop("similarity").join(around, ["a", "b"]).withColumnsRenamed({"a": "centre", "b": "node"})
    more = common.stored(_edit_links(common.stored(edits, "edits")), "pairs")
    more = _compared(more, needed, False).where(F.col("similarity") >= THRESHOLD).select("a", "b")
    return components(roots.select("root", "node").union(more)) if more.take(1) else roots


def classes(base: DataFrame) -> DataFrame:
    """same, keeper_doc, keeper, class_size, n of every distinct `same` of base (node,
    doc, text, same, keys): the row of its class with the least id; n rows have it."""
    with common.scratch(base.sparkSession):
        alike = base.groupBy("same").agg(F.min("node").alias("node"), F.min(F.struct("doc", "node")).alias("least"), F.count(F.lit(1)).alias("n"))
        alike = common.stored(alike, "alike")
        nodes = base.select("node", "keys").where(F.size("keys") > 0).join(alike.select("node"), "node", "left_semi")
        roots = _roots(nodes, base.select("node", "text"))
        alike = alike.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        whole = alike.groupBy("root").agg(F.min("least").alias("least"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("m"))
        whole = common.stored(whole, "roots")
        found = common.hot_join(alike.select("same", "root", "n"), whole.withColumnRenamed("m", "nodes"), ["root"], alike.count(), n="nodes")
        return common.stored(found.select("same", F.col("least.doc").alias("keeper_doc"), F.col("least.node").alias("keeper"), "class_size", "n"), "classes")


def _based(df: DataFrame, text_col: str) -> DataFrame:
    """row (all columns of df), node, same, keys: nothing can clash with the columns."""
    common.prepare(df.sparkSession)
    mark = common.per_text(lambda: marks, _MARK)(common.text_of(text_col))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), mark.alias("mark"), F.monotonically_increasing_id().alias("node"))
    return common.stored(rows.select("row", "node", "mark.same", "mark.keys"), "marked")


def _plain(marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    return marked.select("node", F.col("row")[id_col].alias("doc"), text.alias("text"), "same", "keys")


def _classified(base: DataFrame) -> DataFrame:
    """node, doc, keeper_doc, keeper, class_size of every row of base."""
    return common.hot_join(base.select("node", "doc", "same"), classes(base), ["same"], base.count())


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least id of its class), class_size, kept (true for
    one row of each class), for every row."""
    marked = _based(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), text_col)
    rows = _classified(_plain(marked, id_col, text_col))
    return rows.select(F.col("doc").alias("doc_id"), F.col("keeper_doc").alias("class_id"), "class_size", (F.col("node") == F.col("keeper")).alias("kept"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, all columns of df."""
    marked = _based(df, text_col)
    gone = _classified(_plain(marked, id_col, text_col)).where("node <> keeper").select("node")
    kept = marked.join(_few(common.stored(gone, "dropped")), "node", "left_anti")
    return kept.select(*[F.col("row")[c].alias(c) for c in df.columns])


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
