"""Near-duplicate search with HyperMinHash registers.

Each text becomes its set of word shingles, and each set 192 registers: the hash space is
cut into as many buckets, and a register keeps the leading-zero count and ten mantissa bits of
the smallest hash in its bucket. Empty buckets borrow a register from a bucket that a fixed
permutation names. Bands of these compressed registers bring documents together; the number
of registers in a band is chosen so that a pair at the threshold is missed with a
probability below MISS. Pairs whose Jaccard estimate, corrected for register collisions, lies
SIGMAS deviations under the threshold are dropped, and every other pair is confirmed on its
full sets.

Groups of copies never become all pairs:

* equal sets are one class from the start, so exact copies cost one row each;
* every class is compared with one hub, that of the first and last classes of its band buckets
  which it meets most often, and links make components;
* in buckets that still hold several components, classes are compared with the first and the
  last class of the bucket, if these are of another component;
* buckets that are open even then are compared in blocks of BLOCK classes, block
  pair by block pair in tasks of their own, but only across components. No link between
  different components of a bucket is left untested, whatever the size of the bucket.

Defined results: words are runs of anything but ASCII white space, A-Z lower-cased; a text
with fewer words than a shingle has its whole sequence as one; a text without words, and a
null text, has the empty set and is linked with nothing, its component is its own id;
repeated rows fall into one class; a null id takes part, but never names a component unless
all ids of the component are null; rows are told apart by id and text, so an id may be reused;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.llm.registry import fresh, query, read
from gridsight.session import stage

REGISTERS = 192
MANTISSA = 10
MISS = 1e-6
SIGMAS = 5.0
BLOCK = 256
#: Bytes of text hashed at once, of an Arrow batch; a longer text goes alone.
CHUNK = 1_000_000
WORDS = 5
PERCENT = 80
EMPTY = np.uint16(0xFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0xD6E8FEB86659FD93)
_EDGES = np.array([-(-(j << 64) // REGISTERS) for j in range(REGISTERS)], np.uint64)
#: Where an empty bucket looks for a register: a permutation of all buckets for each.
_BORROW = np.argsort(_mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + _BASE)
                     .reshape(REGISTERS, REGISTERS), axis=1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse mod 2**64, to the powers 0 to n."""
    if len(_powers.get("up", ())) <= n:
        inverse = np.uint64(pow(int(_BASE), -1, 2 ** 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of UTF-8 texts, lower-cased, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.append(True, space[:-1])
    begin = np.flatnonzero(~space & before)
    end = np.flatnonzero(space & ~before)
    up, down = _power(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
        hashes = _mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    upto = np.searchsorted(begin, np.cumsum(sizes))
    return hashes, np.diff(upto, prepend=0)


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text."""
    hashes, sizes = word_hashes(texts)
    n = len(hashes)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, n - words + 1), np.uint64)
        for k in range(words):
            factor = _mix(np.array([k + 1], np.uint64))[0] | np.uint64(1)
            rolled += hashes[k:k + len(rolled)] * factor
        rolled = _mix(rolled)
    out, at = [], 0
    for size in sizes.tolist():
        if size >= words:
            out.append(np.unique(rolled[at:at + size - words + 1]))
        elif size:
            whole = hashlib.blake2b(hashes[at:at + size].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += size
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a sorted set, EMPTY for buckets without a hash."""
    first = np.searchsorted(hashes, _EDGES)
    filled = np.append(first[1:], len(hashes)) > first
    with np.errstate(over="ignore"):
        # The place inside the bucket, as a fraction of 2**64: least for the first hash.
        rest = hashes[first[filled]] * np.uint64(REGISTERS)
    # A float's exponent counts leading zeros and its first fraction bits are the mantissa.
    bits = (rest.astype(np.float64) + 1.0).view(np.uint64) >> np.uint64(52 - MANTISSA)
    zeros = np.uint64(1023 + 64) - (bits >> np.uint64(MANTISSA))
    out = np.full(REGISTERS, EMPTY)
    out[filled] = (zeros << np.uint64(MANTISSA)) | (bits & np.uint64((1 << MANTISSA) - 1))
    return out


def bands(regs: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band of `rows` registers, empty ones borrowed."""
    filled = regs != EMPTY
    if not filled.all():
        source = _BORROW[np.arange(REGISTERS), np.argmax(filled[_BORROW], axis=1)]
        regs = regs[np.where(filled, np.arange(REGISTERS), source)]
    n = REGISTERS // rows
    parts = regs[:n * rows].reshape(n, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        out = np.arange(1, n + 1, dtype=np.uint64) * _BASE
        for k in range(rows):
            out = _mix(out ^ parts[:, k] + np.uint64(k + 1) * _BASE)
    return out.view(np.int64)


def band_rows(percent: int) -> int:
    """Most registers in a band that keep the miss at the threshold below MISS."""
    j = percent / 100
    fits = [r for r in range(1, 13) if (1 - j ** r) ** (REGISTERS // r) < MISS]
    return max(fits, default=1)


def similar(equal: np.ndarray, either: np.ndarray, percent: int) -> np.ndarray:
    """Whether the corrected estimate leaves room for the threshold.

    `equal`: agreeing registers, `either`: buckets filled on either side. Registers of
    different hashes agree with a probability of 0.17 / 2**MANTISSA (Yu and Weber).
    """
    j = percent / 100
    either = np.maximum(either, 1)
    estimate = (equal - 0.1699 * either / 2 ** MANTISSA) / either
    return estimate >= j - SIGMAS * np.sqrt(j * (1 - j) / either)


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of parts of about CHUNK bytes."""
    texts = pc.fill_null(column, "").cast(pa.binary())
    part, first, size = [], 0, 0
    for row, text in enumerate(texts):
        text = text.as_py()
        if part and size + len(text) > CHUNK:
            yield first, part
            part, first, size = [], row, 0
        part.append(text)
        size += len(text) + 1
    if part:
        yield first, part


def _class(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def text_key(text_col: str) -> Column:
    """Tells the texts of rows apart that share an id, or have none."""
    return F.xxhash64(F.col(text_col))


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, rows: int) -> DataFrame:
    """(id, text key, n_shingles, class, bands, registers); the last three null for empty sets."""
    schema = T.StructType([
        T.StructField("_id", docs.schema[id_col].dataType), T.StructField("_key", T.LongType()),
        T.StructField("_n", T.LongType()),
        T.StructField("_class", T.BinaryType()),
        T.StructField("_bands", T.ArrayType(T.LongType(), False)),
        T.StructField("_registers", T.BinaryType())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _texts(batch.column(1)):
                n, classes, keys, regs = [], [], [], []
                for hashes in shingle_sets(texts, words):
                    n.append(len(hashes))
                    if len(hashes):
                        r = registers(hashes)
                        classes.append(_class(hashes))
                        keys.append(bands(r, rows))
                        regs.append(r.tobytes())
                    else:
                        classes.append(None), keys.append(None), regs.append(None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), batch.column(2).slice(first, len(texts)),
                     pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                     pa.array(regs, pa.binary())],
                    [f.name for f in schema])

    return docs.select(F.col(id_col), F.col(text_col), text_key(text_col)).mapInArrow(sketch, schema)


def class_sets(docs: DataFrame, id_col: str, text_col: str, words: int,
               wanted: DataFrame) -> DataFrame:
    """(class, set): full shingle sets of the `wanted` (row: id and key, class), from their texts."""
    row = F.col("_row")
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                         text_key(text_col).alias("_key")).join(
        wanted, (F.col("_key") == row["_key"]) & F.col("_id").eqNullSafe(row["_id"])
    ).select("_text", "_class")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _texts(batch.column(0)):
                classes = batch.column(1).slice(first, len(texts)).to_pylist()
                # Of rows that share an id and a key, only the class asked for.
                found = [(c, s.view(np.int64)) for c, s in zip(classes, shingle_sets(texts, words))
                         if c == _class(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in found], pa.binary()),
                     pa.array([s for _, s in found], pa.list_(pa.int64()))], ["_class", "_set"])

    schema = T.StructType([T.StructField("_class", T.BinaryType()),
                           T.StructField("_set", T.ArrayType(T.LongType(), False))])
    return chosen.mapInArrow(sets, schema)


def _agreement(pairs: DataFrame, percent: int) -> DataFrame:
    """Keep (a, b, registers of both) pairs whose estimate leaves room for the threshold."""
    schema = T.StructType([T.StructField("_a", T.BinaryType()), T.StructField("_b", T.BinaryType())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                for k in (2, 3))
            equal = ((left == right) & (left != EMPTY)).sum(axis=1)
            either = ((left != EMPTY) | (right != EMPTY)).sum(axis=1)
            keep = pa.array(similar(equal, either, percent))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep)], ["_a", "_b"])

    return pairs.select("_a", "_b", "_ra", "_rb").mapInArrow(check, schema)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("_class").alias("_a"), F.col("_set").alias("_sa"))
    right = sets.select(F.col("_class").alias("_b"), F.col("_set").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    either = F.size("_sa") + F.size("_sb") - F.col("_both")
    return (
        pairs.join(left, "_a").join(right, "_b").select("_a", "_b", "_sa", "_sb", both.alias("_both"))
        .where(100 * F.col("_both") >= percent * either).select("_a", "_b"))


def _open_rows(members: DataFrame, percent: int) -> DataFrame:
    """(bucket, i, j, block, class, component): classes to compare exactly, by block pair.

    `members`: (bucket, class, component, registers, bands, blocks of its bucket). A class goes
    to the pairs of its block with every block of the bucket. It stays there if some class of
    the other block is in another component, shares no earlier band with it (else an earlier
    bucket holds the pair) and passes the estimate.
    """
    mine = F.pmod(F.xxhash64("_class"), F.col("_blocks"))
    spread = (
        members.withColumn("_mine", mine)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        .select("_bucket", F.least("_mine", "_other").alias("_i"),
                F.greatest("_mine", "_other").alias("_j"), "_mine", "_class", "_component",
                "_registers", "_bands"))
    kept = ["_bucket", "_i", "_j", "_mine", "_class", "_component"]
    schema = T.StructType([spread.schema[c] for c in kept])

    def look(table: pa.Table) -> pa.Table:
        block = table["_mine"].to_numpy()
        i, j = table["_i"][0].as_py(), table["_j"][0].as_py()
        bucket = table["_bucket"][0].as_py()
        component = pc.dictionary_encode(table["_component"].combine_chunks()).indices.to_numpy()
        regs = np.frombuffer(b"".join(table["_registers"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        keys = np.array(table["_bands"].to_pylist(), np.int64)
        filled = regs != EMPTY
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        stays = np.zeros(len(regs), bool)
        for x in left.tolist():
            others = right[(component[right] != component[x]) & ((right > x) | (i != j))]
            first = np.argmax(keys[others] == keys[x], axis=1)
            others = others[keys[x][first] == bucket]
            equal = ((regs[others] == regs[x]) & filled[x]).sum(axis=1)
            either = (filled[others] | filled[x]).sum(axis=1)
            near = others[similar(equal, either, percent)]
            stays[near] = True
            stays[x] |= len(near) > 0
        return table.select(kept).filter(pa.array(stays))

    return spread.groupBy("_bucket", "_i", "_j").applyInArrow(look, schema)


def _shared(values: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray,
            n: int, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the `left` with the `right` of n sets, by products of
    their membership matrices, some columns at a time."""
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    common = count > 1
    column, owner = (np.cumsum(common) - 1)[column[common[column]]], owner[common[column]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(left), len(right)))
    for at in range(0, int(common.sum()), columns):
        part = slice(*np.searchsorted(column, [at, at + columns]))
        held = np.zeros((n, columns), np.float32)
        held[owner[part], column[part] - at] = 1
        both += held[left] @ held[right].T
    return both


def _block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) across components, block pair by block pair; of the links that
    join the same components of a block pair one is enough."""
    full = rows.join(sets, "_class")
    schema = T.StructType([T.StructField("_a", T.BinaryType()), T.StructField("_b", T.BinaryType())])

    def compare(table: pa.Table) -> pa.Table:
        block = table["_mine"].to_numpy()
        left = np.flatnonzero(block == table["_i"][0].as_py())
        right = np.flatnonzero(block == table["_j"][0].as_py())
        classes = table["_class"].to_pylist()
        component = pc.dictionary_encode(table["_component"].combine_chunks()).indices.to_numpy()
        held = table["_set"].combine_chunks()
        sizes = pc.list_value_length(held).to_numpy()
        both = _shared(held.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes), left, right,
                       len(sizes))
        either = sizes[left][:, None] + sizes[right][None, :] - both
        linked = (100 * both >= percent * either) & (component[left][:, None] != component[right][None, :])
        leader = {}

        def top(x: int) -> int:
            while leader.get(x, x) != x:
                leader[x] = leader.get(leader[x], leader[x])
                x = leader[x]
            return x

        a, b = [], []
        for x, y in zip(*(side.tolist() for side in np.nonzero(linked))):
            x, y = left[x], right[y]
            up, down = top(int(component[x])), top(int(component[y]))
            if up != down:
                leader[up] = down
                a.append(max(classes[x], classes[y])), b.append(min(classes[x], classes[y]))
        return pa.table({"_a": pa.array(a, pa.binary()), "_b": pa.array(b, pa.binary())})

    return full.groupBy("_bucket", "_i", "_j").applyInArrow(compare, schema)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for all nodes of the stored `links` (a, b): the least node reachable.

    Labels go over the links and then jump to the label of the label, until none changes;
    links and labels are stored tables, so a hub is split like any skewed join key.
    """
    both = stage(links.select("_a", "_b").union(links.select("_b", "_a")).distinct(), "links")
    labels = stage(both.groupBy(F.col("_a").alias("_node")).agg(
        F.least(F.min("_b"), F.first("_a")).alias("_label")), "labels")
    while True:
        other = labels.select(F.col("_node").alias("_b"), F.col("_label").alias("_near"))
        near = both.join(other, "_b").groupBy("_a").agg(F.min("_near").alias("_near"))
        hooked = stage(
            labels.join(near, F.col("_node") == F.col("_a"), "left")
            .select("_node", F.least("_label", "_near").alias("_next"),
                    F.col("_label").alias("_was")), "hooked")
        up = hooked.select(F.col("_node").alias("_up"), F.col("_next").alias("_jump"))
        jumped = stage(
            hooked.join(up, F.col("_next") == F.col("_up"), "left")
            .select("_node", F.least("_next", "_jump").alias("_label"), "_was"), "labels")
        if jumped.where(F.col("_label") != F.col("_was")).isEmpty():
            return jumped.select("_node", "_label")
        labels = jumped.select("_node", "_label")


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """(node, label) after `more` stored links (a, b) joined the components of the stored `labels`.

    The links are taken between components, so what was joined before is not gone over again.
    """
    ends = more.select(F.explode(F.array("_a", "_b")).alias("_new")).distinct()
    nodes = stage(
        labels.join(ends, F.col("_node") == F.col("_new"), "full")
        .select(F.coalesce("_node", "_new").alias("_node"), F.coalesce("_label", "_new").alias("_label")), "nodes")
    of_a = nodes.select(F.col("_node").alias("_na"), F.col("_label").alias("_la"))
    of_b = nodes.select(F.col("_node").alias("_nb"), F.col("_label").alias("_lb"))
    between = (
        more.join(of_a, F.col("_a") == F.col("_na")).join(of_b, F.col("_b") == F.col("_nb"))
        .where(F.col("_la") != F.col("_lb"))
        .select(F.greatest("_la", "_lb").alias("_a"), F.least("_la", "_lb").alias("_b")))
    top = components(between).select(F.col("_node").alias("_from"), F.col("_label").alias("_to"))
    return stage(nodes.join(top, F.col("_label") == F.col("_from"), "left").select(
        "_node", F.coalesce("_to", "_label").alias("_label")), "labels")


def _star_links(star: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) of the pairs (x, y), each taken once."""
    pairs = star.select(F.greatest("_x", "_y").alias("_a"), F.least("_x", "_y").alias("_b")).distinct()
    a = known.select(F.col("_class").alias("_a"), F.col("_registers").alias("_ra"))
    b = known.select(F.col("_class").alias("_b"), F.col("_registers").alias("_rb"))
    near = _agreement(pairs.join(a, "_a").join(b, "_b"), percent)
    return stage(_confirmed(near, sets, percent), "confirmed")


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, class, first, last, component, size) of buckets that hold several components."""
    labelled = (
        shared.join(labels, F.col("_class") == F.col("_node"), "left")
        .select("_bucket", "_class", "_first", "_last",
                F.coalesce("_label", "_class").alias("_component")))
    several = labelled.groupBy("_bucket").agg(
        F.min("_component").alias("_least"), F.max("_component").alias("_most"),
        F.count(F.lit(1)).alias("_size")).where(F.col("_least") < F.col("_most"))
    return labelled.join(several.select("_bucket", "_size"), "_bucket")


def labelled_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text key, n_shingles, class, label) of every row; label: a class that stands for the
    component, null without words.

    `docs` is read twice: once for the sketches, once for the texts of classes that share a
    bucket with another class.
    """
    rows = band_rows(percent)
    sketched = stage(sketches(docs, id_col, text_col, words, rows), "sketches")
    filled = sketched.where(F.col("_class").isNotNull())

    members = filled.select("_class", F.explode("_bands").alias("_bucket"))
    ends = members.groupBy("_bucket").agg(F.min("_class").alias("_first"), F.max("_class").alias("_last"))
    shared = stage(
        members.join(ends.where(F.col("_first") < F.col("_last")), "_bucket").distinct(), "buckets")
    crowd = shared.select("_class").distinct()
    known = stage(
        filled.join(crowd, "_class", "left_semi")
        .groupBy("_class").agg(F.min(F.struct("_id", "_key")).alias("_row"),
                               F.first("_registers").alias("_registers"),
                               F.first("_bands").alias("_bands")), "classes")
    sets = stage(class_sets(docs, id_col, text_col, words, known.select("_row", "_class"))
                 .dropDuplicates(["_class"]), "sets")

    # One hub for each class: the one it shares most buckets with is the likeliest to be linked.
    hubs = (
        shared.select(F.col("_class").alias("_x"), F.explode(F.array("_first", "_last")).alias("_y"))
        .where(F.col("_x") != F.col("_y"))
        .groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_met"))
        .groupBy("_x").agg(F.max(F.struct("_met", "_y")).alias("_hub"))
        .select("_x", F.col("_hub")["_y"].alias("_y")))
    labels = components(_star_links(hubs, known, sets, percent))

    # What that left open meets both ends of its buckets, across components only.
    apart = _open(shared, labels)
    end = (
        apart.select(F.col("_class").alias("_x"), F.col("_component").alias("_of"),
                     F.explode(F.array("_first", "_last")).alias("_y")).distinct()
        .join(labels.select(F.col("_node").alias("_y"), F.col("_label").alias("_other")), "_y", "left")
        .where(F.col("_of") != F.coalesce("_other", "_y")))
    more = _star_links(end, known, sets, percent)
    if not more.isEmpty():
        labels = merged(labels, more)

    # Buckets that are open even now, in blocks.
    rest = (
        _open(shared, labels)
        .select("_bucket", "_class", "_component", F.ceil(F.col("_size") / BLOCK).alias("_blocks"))
        .join(known.select("_class", "_registers", "_bands"), "_class"))
    more = stage(_block_links(_open_rows(rest, percent), sets, percent), "confirmed")
    if not more.isEmpty():
        labels = merged(labels, more)

    return stage(
        sketched.select("_id", "_key", "_n", "_class")
        .join(labels, F.col("_class") == F.col("_node"), "left")
        .select("_id", "_key", "_n", "_class", F.coalesce("_label", "_class").alias("_label")), "labelled")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept): components of texts linked at `percent`."""
    labelled = labelled_rows(docs, words, percent, id_col, text_col)
    least = stage(labelled.where(F.col("_label").isNotNull())
                  .groupBy(F.col("_label").alias("_of")).agg(F.min("_id").alias("_least")), "least")
    named = labelled.join(least, F.col("_label") == F.col("_of"), "left")
    component = F.when(F.col("_label").isNull(), F.col("_id")).otherwise(F.col("_least"))
    return named.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"),
                        component.alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each component: the first by id (null last), shingles and text.

    Rows are told apart by id and text: a reused id takes nothing away from other texts, and
    rows without an id are copies like any other. Texts without words stay, repeated ones of
    one id once.
    """
    labelled = labelled_rows(docs, words, percent, id_col, text_col)
    rows = labelled.groupBy("_id", "_key", "_class", "_label").agg(F.count(F.lit(1)).alias("_copies"))
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_class", "_key")
    first = stage(rows.where(F.col("_label").isNotNull()).groupBy(F.col("_label").alias("_of"))
                  .agg(F.min(order).alias("_first")), "first")
    told = rows.join(first, F.col("_label") == F.col("_of"), "left").select(
        "_id", "_key", (F.col("_label").isNotNull() & (order != F.col("_first"))).alias("_gone"),
        ((F.col("_copies") > 1) & (F.col("_label").isNotNull() | F.col("_id").isNotNull())).alias("_again"))
    told = stage(told.where(F.coalesce(F.col("_gone"), F.lit(False)) | F.col("_again")), "told")

    names = {c: fresh(docs.columns, c) for c in ("_of_id", "_of_key", "_out", "_repeats")}
    verdicts = told.select(
        F.col("_id").alias(names["_of_id"]), F.col("_key").alias(names["_of_key"]),
        F.col("_gone").alias(names["_out"]), F.col("_again").alias(names["_repeats"]))
    judged = docs.join(
        verdicts, (text_key(text_col) == F.col(names["_of_key"]))
        & F.col(id_col).eqNullSafe(F.col(names["_of_id"])), "left")
    stays = ~F.coalesce(F.col(names["_out"]), F.lit(False))
    repeats = F.coalesce(F.col(names["_repeats"]), F.lit(False))
    return judged.where(stays & ~repeats).select(*docs.columns).unionAll(
        judged.where(stays & repeats).dropDuplicates([names["_of_id"], names["_of_key"]])
        .select(*docs.columns))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END)) AS s
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
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(other, d.doc_id) AS component_id,
  d.doc_id = coalesce(other, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


@query("op6_near_duplicates", ORACLE)
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 85 % of their three-word shingles."""
    return near_duplicates(read(spark, sf_dir, "documents"), words=3, percent=85)
