"""N-gram Jaccard join with signature trees.

Texts become sets of word shingles; equal sets are one class. Two sets that reach the
threshold differ in few shingles, which gives an exact way to bring them together: the hash
space is cut into more segments than shingles may differ, so at least one segment holds the
same shingles on both sides. The number of segments depends on the larger possible size of a
pair, so each set takes part with the sizes from its own interval up and with those from the
interval below. A set with too many empty segments adds a prefix filter: the first of its
hashes in order, one of which a partner must share. No pair that links fails to share a key.

Sets that meet are joined by signature trees. Tokens that several sets of the two trees hold get
a bit each, as far as BITS times the largest set go; beyond, several tokens share one. A node holds the OR of the
bitmaps of its sets, the range of their sizes, and how many tokens may hide behind one bit. For
two nodes no pair of sets can share more tokens than the bits common to both, plus those hidden,
nor more than the smaller of the largest sizes; pairs of nodes whose best case is under the
threshold are dropped with all below them, and pairs of sets that remain are confirmed on full
sets (where no token is hidden, their bitmaps are the full sets). Pairs of nodes that lie in one
component already are dropped likewise.

Sets meet in groups: a key's sets belong to the least of them, their hub, and with that hub to
its own least hub, so that sets which share many keys, or share them with the same others, meet
once or a few times instead of once a key. Large groups of near copies do not become all pairs of rows. First every set goes to its
least hub, where blocks of a bounded number of sets and tokens are joined with themselves; in
groups of several blocks one set of each component found does so again. What remains are groups
not wholly compared that still hold several components. Their largest component is cut into blocks that meet the blocks of all others, and
these meet each other, but the largest one never meets itself: every pair that could join two
components is tested, whatever the size of a group.

Defined results: words are runs of anything but ASCII white space, A-Z lower-cased; a text with
fewer words than a shingle has its whole sequence as one; a text without words, and a null text,
has the empty set, is linked with nothing and is its own component; repeated rows and rows that
share an id each are a row of their own; a null id takes part, but names a component only
if all ids of the component are null; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.llm.near_dup import _mix, _texts, components, merged, shingle_sets
from gridsight.llm.registry import query, read
from gridsight.session import stage

WORDS = 4
PERCENT = 85
#: Sets and tokens of a block.
BLOCK = 1024
BLOCK_TOKENS = 500_000
#: Children of a tree node; bits of a bitmap for each token of the largest set, and at most.
FAN = 8
BITS = 8
MAX_BITS = 1 << 16
#: Words of bitmaps looked at together.
CHUNK = 1 << 21
_SALT = np.uint64(0x9FB21C651E98DF25)


@functools.cache
def _ends(percent: int) -> list[int]:
    """Largest sizes of the intervals, as far as they were asked for; the first holds size 1."""
    return [1]


def interval_end(at: int, percent: int) -> int:
    ends = _ends(percent)
    while len(ends) <= at:
        ends.append(100 * (ends[-1] + 1) // percent)
    return ends[at]


def interval(size: int, percent: int) -> int:
    """Number of the size interval; each ends at the largest set that its first one may link."""
    ends = _ends(percent)
    while ends[-1] < size:
        interval_end(len(ends), percent)
    return bisect.bisect_left(ends, size)


def differing(at: int, percent: int) -> int:
    """Most shingles by which a linked pair differs whose smaller set is in interval `at`."""
    small = interval_end(at, percent)
    large = 100 * small // percent
    return (100 - percent) * (small + large) // (100 + percent)


def segments(at: int, percent: int) -> int:
    """Segments for interval `at`, some more than may differ."""
    most = differing(at, percent)
    return most + 1 + -(-most // 16) if most else 0


@functools.lru_cache(4096)
def _edges(n: int) -> np.ndarray:
    return np.array([-(-(j << 64) // n) for j in range(n)], np.uint64)


def keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Key hashes (int64, distinct) of a sorted set; linked sets that differ share one."""
    size, out = len(hashes), []
    if not size:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        sums = np.append(np.uint64(0), np.cumsum(_mix(hashes ^ _SALT)))
        for at in range(interval(-(-percent * size // 100), percent), interval(size, percent) + 1):
            n = segments(at, percent)
            if not n:
                continue
            begin = np.searchsorted(hashes, _edges(n))
            end = np.append(begin[1:], size)
            filled = np.flatnonzero(end > begin)
            salt = _mix(np.array([at + 1], np.uint64) * _SALT)
            out.append(_mix((sums[end] - sums[begin])[filled]
                            ^ _mix(filled.astype(np.uint64) + salt)))
            if n - len(filled) >= n - differing(at, percent):
                # Equal segments may all be empty ones.
                first = size - (-(-percent * size // 100)) + 1
                out.append(_mix(hashes[:first] ^ _mix(salt)))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


def bit_numbers(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """For each set the bits of its tokens that some other set holds too, and the bits in use."""
    if not sets:
        return [], 64
    sizes = [len(s) for s in sets]
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count > 1
    useful = max(1, min(int(common.sum()), BITS * max(sizes), MAX_BITS))
    bits = max(64, 1 << (useful - 1).bit_length())
    number = (np.cumsum(common) - 1) % bits
    ends = np.cumsum([0, *sizes])
    parts = [token[lo:hi] for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return [number[t[common[t]]] for t in parts], bits


class SignatureTree:
    """Bitmaps, size ranges and hidden tokens of sets, level by level; level 0 are the sets."""

    def __init__(self, sets: list[np.ndarray], numbers: list[np.ndarray], bits: int, component: np.ndarray):
        # Sets with a smallest hash in common are likely alike and get one parent.
        self.order = np.lexsort(([s[0] for s in sets], [len(s) for s in sets])) if sets else np.empty(0, int)
        self.sets = [sets[i] for i in self.order]
        sizes = np.array([len(s) for s in self.sets])
        words = np.zeros((len(sets), bits // 64), np.uint64)
        for row, i in zip(words, self.order):
            held = np.zeros(bits, bool)
            held[numbers[i]] = True
            row[:] = np.packbits(held).view(np.uint64)
        marked = np.array([len(numbers[i]) for i in self.order])
        hidden = marked - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        one = component[self.order]
        #: (bitmaps, least size, largest size, most hidden tokens, component or -1) of a level
        self.levels = [(words, sizes, sizes, hidden, one)]
        while len(words) > 1:
            starts = np.arange(0, len(words), FAN)
            words = np.bitwise_or.reduceat(words, starts)
            _, least, most, hidden, one = self.levels[-1]
            low, high = np.minimum.reduceat(one, starts), np.maximum.reduceat(one, starts)
            self.levels.append((
                words, np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts),
                np.maximum.reduceat(hidden, starts), np.where(low == high, low, -1)))


def may_link(left: tuple, right: tuple, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """The largest possible overlap of node pairs, or -1 where it is under the threshold."""
    (wa, la, ma, ha, ca), (wb, lb, mb, hb, cb) = left, right
    out = np.full(len(i), -1, np.int64)
    step = max(1, CHUNK // wa.shape[1])
    for at in range(0, len(i), step):
        x, y = i[at:at + step], j[at:at + step]
        shared = np.bitwise_count(wa[x] & wb[y]).sum(axis=1, dtype=np.int64) + np.minimum(ha[x], hb[y])
        most = np.minimum(shared, np.minimum(ma[x], mb[y]))
        fits = (100 + percent) * most >= percent * (la[x] + lb[y])
        fits &= (ca[x] != cb[y]) | (ca[x] < 0)
        out[at:at + step] = np.where(fits, most, -1)
    return out


def candidates(a: SignatureTree, b: SignatureTree, percent: int) -> tuple[np.ndarray, ...]:
    """(x, y, largest overlap) of the pairs of sets that a dual traversal leaves."""
    depth_a, depth_b = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        most = may_link(a.levels[depth_a], b.levels[depth_b], i, j, percent)
        if a is b and depth_a == depth_b:
            most[i > j] = -1
        keep = most >= 0
        i, j, most = i[keep], j[keep], most[keep]
        if not depth_a and not depth_b:
            return i, j, most
        # The higher side goes down; both if they stand on one level.
        down_a, down_b = depth_a >= depth_b, depth_b >= depth_a
        if down_a:
            depth_a -= 1
            i, j = np.repeat(i * FAN, FAN) + np.tile(np.arange(FAN), len(i)), np.repeat(j, FAN)
        if down_b:
            depth_b -= 1
            i, j = np.repeat(i, FAN), np.repeat(j * FAN, FAN) + np.tile(np.arange(FAN), len(j))
        there = (i < len(a.levels[depth_a][1])) & (j < len(b.levels[depth_b][1]))
        i, j = i[there], j[there]


def links(left: list[np.ndarray], right: list[np.ndarray] | None, component: np.ndarray,
          percent: int) -> list[tuple[int, int]]:
    """Linked pairs (numbers over left, then right) that join components: of the sets of one
    block with each other if `right` is None, else of two blocks. Links that a forest of the
    pairs found before holds already are not looked for."""
    n = len(left)
    numbers, bits = bit_numbers([*left, *(right or [])])
    a = SignatureTree(left, numbers[:n], bits, component[:n])
    b = a if right is None else SignatureTree(right, numbers[n:], bits, component[n:])
    if not a.sets or not b.sets:
        return []
    x, y, most = candidates(a, b, percent)
    sure = (a.levels[0][3][x] == 0) | (b.levels[0][3][y] == 0)
    # Best first: pairs that almost surely link save the others in their component.
    best = np.argsort(-most / (a.levels[0][1][x] + b.levels[0][1][y]), kind="stable")
    leader: dict[int, int] = {}

    def top(c: int) -> int:
        while leader.get(c, c) != c:
            leader[c] = leader.get(leader[c], leader[c])
            c = leader[c]
        return c

    out = []
    one, two = a.levels[0][4].tolist(), b.levels[0][4].tolist()
    open_ = len({*one, *two}) - 1
    for p, q, known in zip(x[best].tolist(), y[best].tolist(), sure[best].tolist()):
        up, down = top(one[p]), top(two[q])
        if up == down:
            continue
        s, t = a.sets[p], b.sets[q]
        shared = 0 if known else len(np.intersect1d(s, t, assume_unique=True))
        if known or 100 * shared >= percent * (len(s) + len(t) - shared):
            leader[up] = down
            out.append((int(a.order[p]), int(b.order[q]) + (0 if right is None else n)))
            if len(out) == open_:
                break
    return out


def _sketched(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, text hash, n, class, keys); the last two null for empty sets."""
    schema = T.StructType([
        T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_hash", T.LongType()),
        T.StructField("_n", T.LongType()), T.StructField("_class", T.BinaryType()),
        T.StructField("_keys", T.ArrayType(T.LongType(), False))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _texts(batch.column(2)):
                sets = shingle_sets(texts, words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([class_of(s) if len(s) else None for s in sets], pa.binary()),
                     pa.array([keys(s, percent) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    [f.name for f in schema])

    return docs.select(F.col(id_col), F.xxhash64(text_col), F.col(text_col)).mapInArrow(sketch, schema)


def class_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _texts_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """(node, text): a text of every `wanted` (node, class, id, text hash)."""
    found = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                    F.xxhash64(text_col).alias("_of"))
        .join(wanted, (F.col("_of") == F.col("_hash")) & F.col("_id").eqNullSafe(F.col("_wanted")))
        .select("_text", "_class", "_node"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Another text may have the same id and hash; the class tells them apart.
        for batch in batches:
            for first, texts in _texts(batch.column(0)):
                part = batch.slice(first, len(texts))
                same = [class_of(s) == c for s, c in zip(shingle_sets(texts, words), part.column(1).to_pylist())]
                yield part.filter(pa.array(same, pa.bool_())).select(["_node", "_text"])

    return found.mapInArrow(check, "_node long, _text string").dropDuplicates(["_node"])


def _joined(rows: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Forest links (a, b) of every group (hub, i, j) of (node, mine, component): of block i
    with block j, or of a block with itself."""
    schema = T.StructType([T.StructField("_a", T.LongType()), T.StructField("_b", T.LongType())])

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = table["_i"][0].as_py(), table["_j"][0].as_py()
        block = table["_mine"].to_numpy()
        left = np.flatnonzero(block == i)
        order = left if i == j else np.concatenate([left, np.flatnonzero(block == j)])
        sets: list[np.ndarray] = []
        for _, part in _texts(table["_text"].chunk(0).take(pa.array(order))):
            sets.extend(shingle_sets(part, words))
        component = pc.dictionary_encode(table["_component"].chunk(0)).indices.to_numpy()[order]
        found = np.array(links(sets[:len(left)], sets[len(left):] if i != j else None, component, percent),
                         np.int64)
        found = table["_node"].to_numpy()[order][found.reshape(-1, 2)]
        return pa.table({"_a": pa.array(found.max(axis=1)), "_b": pa.array(found.min(axis=1))})

    return rows.join(texts, "_node").select(
        "_hub", "_i", "_j", "_mine", "_node", "_component", "_text").groupBy(
        "_hub", "_i", "_j").applyInArrow(join, schema)


def _blocks(size: str, tokens: str) -> Column:
    return F.greatest(F.ceil(F.col(size) / BLOCK), F.ceil(F.col(tokens) / BLOCK_TOKENS), F.lit(1))


def _open(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the groups (hub, node, n) that hold several components, with `_component`."""
    labelled = (
        groups.join(labels.select(F.col("_node").alias("_of"), "_label"), F.col("_node") == F.col("_of"), "left")
        .select("_hub", "_node", "_n", F.coalesce("_label", "_node").alias("_component")))
    several = labelled.groupBy(F.col("_hub").alias("_of")).agg(
        F.min("_component").alias("_low"), F.max("_component").alias("_high")
    ).where(F.col("_low") < F.col("_high"))
    return labelled.join(several, F.col("_hub") == F.col("_of"), "left_semi")


def _homes(rows: DataFrame) -> DataFrame:
    """One set of each component of the open `rows`, in blocks of its component's least hub."""
    chosen = rows.groupBy("_component").agg(F.min(F.struct("_hub", "_node", "_n")).alias("_least")).select(
        "_component", "_least.*")
    sizes = chosen.groupBy(F.col("_hub").alias("_of")).agg(
        F.count(F.lit(1)).alias("_size"), F.sum("_n").alias("_tokens")).where(F.col("_size") > 1)
    return (
        chosen.join(sizes, F.col("_hub") == F.col("_of"))
        .withColumn("_parts", _blocks("_size", "_tokens"))
        .withColumn("_i", F.pmod(F.xxhash64("_node"), F.col("_parts")))
        .select("_hub", "_i", F.col("_i").alias("_j"), F.col("_i").alias("_mine"), "_node", "_component",
                "_parts"))


def _across(rows: DataFrame) -> DataFrame:
    """All sets of the open `rows` in all pairs of blocks but those inside the largest component."""
    counts = rows.groupBy(F.col("_hub").alias("_of"), "_component").agg(
        F.count(F.lit(1)).alias("_size"), F.sum("_n").alias("_tokens"))
    sizes = counts.groupBy("_of").agg(
        F.max(F.struct("_size", "_component", "_tokens")).alias("_main"),
        F.sum("_size").alias("_all"), F.sum("_tokens").alias("_all_tokens")).select(
        "_of", F.col("_main._component").alias("_largest"),
        _blocks("_main._size", "_main._tokens").alias("_inner"),
        (F.col("_all") - F.col("_main._size")).alias("_rest"),
        (F.col("_all_tokens") - F.col("_main._tokens")).alias("_rest_tokens")).withColumn(
        "_outer", _blocks("_rest", "_rest_tokens"))
    # Blocks 0 to inner - 1 hold the largest component, the next ones all others.
    digest, main = F.xxhash64("_node"), F.col("_component") == F.col("_largest")
    return (
        rows.join(sizes, F.col("_hub") == F.col("_of"))
        .withColumn("_mine", F.when(main, F.pmod(digest, "_inner")).otherwise(
            F.col("_inner") + F.pmod(digest, "_outer")))
        .withColumn("_other", F.explode(F.sequence(
            F.when(main, F.col("_inner")).otherwise(F.lit(0).cast("long")),
            F.col("_inner") + F.col("_outer") - 1)))
        .select("_hub", F.least("_mine", "_other").alias("_i"), F.greatest("_mine", "_other").alias("_j"),
                "_mine", "_node", "_component"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): components of texts linked at `percent`.

    `docs` is read three times: for the classes, for their keys, and for the texts that meet.
    """
    sketched = stage(
        _sketched(docs, id_col, text_col, words, percent).drop("_keys")
        .withColumn("_row", F.monotonically_increasing_id()), "signatures")
    filled = sketched.where(F.col("_class").isNotNull())
    # Equal sets are one node, named by the least of their row numbers.
    nodes = stage(filled.groupBy("_class").agg(
        F.min("_row").alias("_node"), F.first("_n").alias("_n")), "nodes")
    # Keys are as large as the texts: they are made again rather than stored.
    keyed = (
        _sketched(docs, id_col, text_col, words, percent).where(F.col("_class").isNotNull())
        .groupBy("_class").agg(F.first("_keys").alias("_keys")))
    key = Window.partitionBy("_key")
    held = (
        keyed.join(nodes, "_class").select("_node", "_n", F.explode("_keys").alias("_key"))
        .withColumn("_size", F.count(F.lit(1)).over(key)).withColumn("_hub", F.min("_node").over(key)))
    hubs = stage(held.where(F.col("_size") > 1).groupBy("_hub", "_node").agg(F.first("_n").alias("_n")), "hubs")
    # A hub's group joins that of the hub's own least hub.
    above = hubs.groupBy(F.col("_node").alias("_of")).agg(F.min("_hub").alias("_root"))
    groups = stage(
        hubs.join(above, F.col("_hub") == F.col("_of"))
        .groupBy(F.col("_root").alias("_hub"), "_node").agg(F.first("_n").alias("_n")), "groups")
    wanted = (
        filled.select("_row", "_class", "_hash", "_id")
        .join(groups.select("_node").distinct(), F.col("_row") == F.col("_node"))
        .select("_node", "_class", "_hash", F.col("_id").alias("_wanted")))
    texts = stage(_texts_of(docs, id_col, text_col, wanted, words), "texts")

    homes = stage(_homes(groups.withColumn("_component", F.col("_node"))), "homes")
    labels = components(stage(_joined(homes, texts, words, percent), "links"))
    # Groups that were one block have met as a whole.
    met = homes.groupBy("_hub").agg(F.max("_parts").alias("_parts"), F.count(F.lit(1)).alias("_there")).where(
        F.col("_parts") == 1)
    sizes = groups.groupBy("_hub").agg(F.count(F.lit(1)).alias("_size"), F.sum("_n").alias("_tokens"))
    left = stage(
        sizes.join(met, "_hub", "left").where(F.coalesce("_there", F.lit(0)) < F.col("_size"))
        .select("_hub", (_blocks("_size", "_tokens") > 1).alias("_crowded")), "left")
    rest = stage(groups.join(left, "_hub"), "rest")
    crowded = rest.where("_crowded")
    if not crowded.isEmpty():
        second = stage(_joined(_homes(_open(crowded, labels)), texts, words, percent), "links")
        if not second.isEmpty():
            labels = merged(labels, second)
    last = stage(_joined(_across(_open(rest, labels)), texts, words, percent), "links")
    if not last.isEmpty():
        labels = merged(labels, last)

    named = stage(
        sketched.select("_id", "_n", "_class")
        .join(nodes.select(F.col("_class").alias("_of"), "_node"), F.col("_class") == F.col("_of"), "left")
        .join(labels.select(F.col("_node").alias("_labelled"), "_label"),
              F.col("_node") == F.col("_labelled"), "left")
        .select("_id", "_n", F.coalesce("_label", "_node").alias("_component")), "named")
    least = named.where(F.col("_component").isNotNull()).groupBy(F.col("_component").alias("_of")).agg(
        F.min("_id").alias("_least"))
    return named.join(least, F.col("_component") == F.col("_of"), "left").select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"),
        F.when(F.col("_component").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("component_id"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END)) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
reach AS (
  SELECT a AS doc_id, a AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least_of AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(other, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


@query("op13_jaccard_join", ORACLE)
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their four-word shingles."""
    return jaccard_components(read(spark, sf_dir, "documents"))
