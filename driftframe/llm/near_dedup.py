"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping.

A document's set holds its distinct shingles of ``shingle`` words; two documents are linked if their sets' similarity is at least
``least`` hundredths. SuperMinHash deals each element a random
permutation of the signature's slots: in round j the element bids j plus a random fraction at the j-th slot of its
permutation, and a slot keeps its lowest bid. Bids of one element are spread over the slots without repeats, which
lowers the variance against independent hashes, and a document is done in the first round that leaves no slot empty.
Bands have ``ROWS`` slots. There are as many as it takes for two sets just at the bound to share no band with a chance of at most
``MISS``: 25 at similarity 0.85, 37 at 0.8.

How links are found without comparing all pairs of a group:

* Documents with equal sets form one class; only classes go on.
* In each bucket of a band every class is compared with one hub, the class that shares most with others. In a group
  of copies of one original that is the original or a copy close to it, so nearly all links are found here.
* What is left are members whose component is not their hub's. A member is now known by its differences from the hub,
  the elements it adds and those it lacks. With H the hub's size, ``g = 100 * lacking + least * added`` and D the
  differences that two members have in common, they are linked if and only if
  ``(100 + least) * D >= g_x + g_y - (100 - least) * H``. A member apart from the hub has ``g > (100 - least) * H``, so
  it can be linked only with members that share differences with it, and never by what all copies have in common.
* Each member apart is first compared, for each of its differences, with the member closest to the hub that has it too.
  That is one pair a difference at most, whatever the size of the group, and it joins most of what belongs together.
* For what is still apart an exact prefix filter on differences, the rarest of the group first, finds the pairs that can
  share enough of them; their places in the order and two 64-bit bitmaps of the differences bound D from above inside
  the join; the pairs left are compared by their differences.

So every pair of classes that shares a bucket is either in one component already, compared, or ruled out exactly.
Buckets, hubs and copies may be large: counts and hubs are partial aggregates, and the joins carry plain keys that AQE
can split. Where copies differ by what they lack, differences coincide by chance, and the pairs that the join looks at
(not those it puts out) can still grow with the square of a group; they cost a few comparisons of numbers each.

Defined results: a null, empty or wordless text has an empty set, is linked with nothing and kept; fewer words than a
shingle make one shingle; repeated rows are copies; rows of one doc_id with different texts are different documents (a component is named by its smallest doc_id);
rows without doc_id join their class but name no component, and are kept only if no row of it has an id; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftframe.durable import cut, release, ship
from driftframe.llm.blocks import U64, blocks, mix
from driftframe.llm.components import components, joined
from driftframe.llm.rows import row_hash

#: Fixed values of op6_near_dedup. Other callers name their own.
SHINGLE, LEAST = 3, 85
ROWS, MISS = 5, 5e-7


def bands_for(least: int) -> int:
    """The least number of bands that miss a pair of similarity ``least / 100`` with a chance of at most ``MISS``."""
    return math.ceil(math.log(MISS) / math.log1p(-((least / 100) ** ROWS))) if least < 100 else 1


BANDS = bands_for(LEAST)
SLOTS = BANDS * ROWS
MAX_BROADCAST = 32_000_000  # bytes of numbers
PAIRS = 500  # whose differences are put out together
_EMPTY = np.iinfo(np.uint64).max


@lru_cache
def _band_keys(bands: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, (bands, ROWS), dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Per block: its rows, the distinct shingle hashes of each document in ascending order, and where each document's begin."""
    for b in blocks(column, lower=True):
        words = b.word_hashes()
        full = b.windows(words, shingle)
        parts = []
        for lo, hi in zip(b.first[:-1].tolist(), b.first[1:].tolist()):
            n = hi - lo
            part = full[lo : hi - shingle + 1] if n >= shingle else b.windows(words[lo:hi], n) ^ U64(n) if n else words[:0]
            parts.append(np.unique(part))
        yield b.rows, np.concatenate(parts) if parts else words[:0], np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


def _draw(x: np.ndarray, j: int) -> np.ndarray:
    return mix(x + U64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))


def signatures(elements: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each set (rows of a set without elements stay empty). A bid is the round in the upper byte and the
    random fraction below it."""
    n = len(first) - 1
    bids = np.full(n * slots, _EMPTY, U64)
    owner = np.repeat(np.arange(n), np.diff(first))
    here, deck = np.arange(len(elements)), None
    for j in range(slots):
        r = _draw(elements[here], j)
        k = j + (r & U64(0xFFFF)).astype(np.int64) * (slots - j) // 65536
        if deck is None:
            slot = k
        else:
            at = np.arange(len(here))
            slot = deck[at, k].astype(np.int64)
            deck[at, k] = deck[at, j]
            deck[at, j] = slot
        np.minimum.at(bids, owner[here] * slots + slot, (r >> U64(8)) | U64(j << 56))
        open_ = (bids.reshape(n, slots) == _EMPTY).any(1)
        left = open_[owner[here]]
        if not left.any():
            break
        if deck is None:
            deck = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (int(left.sum()), 1))
            at = np.arange(len(deck))
            deck[at, k[left]], deck[:, 0] = 0, k[left]
            here = here[left]
        elif left.sum() < 0.7 * len(here):
            here, deck = here[left], deck[left]
    return bids.reshape(n, slots)


def band_hashes(bids: np.ndarray) -> np.ndarray:
    bands = bids.shape[1] // ROWS
    parts = mix(bids.reshape(len(bids), bands, ROWS)) * _band_keys(bands)[None]
    return mix(parts.sum(2, dtype=U64) + np.arange(bands, dtype=U64)[None] * U64(0x9E3779B97F4A7C15))


def _names(elements: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    raw = memoryview(elements.tobytes())
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _signer(shingle: int, bands: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, elements, first in shingle_sets(batch.column("text"), shingle):
                hashes = band_hashes(signatures(elements, first, bands * ROWS)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first), dtype=np.int32) * bands), pa.array(hashes.ravel()))
                yield pa.record_batch([batch.column("doc_id")[rows], batch.column("text_key")[rows], pa.array(np.diff(first)), pa.array(_names(elements, first), pa.binary()), lists], ["doc_id", "text_key", "n_shingles", "node", "bands"])

    return run


def _sets(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, elements, first in shingle_sets(batch.column("text"), shingle):
                raw = elements.tobytes()
                sets = [raw[8 * a : 8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                yield pa.record_batch([pa.array(_names(elements, first), pa.binary()), pa.array(sets, pa.binary())], ["node", "elements"])

    return run


def linked(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> tuple[bool, np.ndarray]:
    """Whether two ascending sets are similar enough, and which elements of ``b`` are in ``a``."""
    at = np.searchsorted(a, b)
    shared = a[np.minimum(at, len(a) - 1)] == b
    both = int(shared.sum())
    return 100 * both >= least * (len(a) + len(b) - both), shared


def _bitmap(differences: np.ndarray) -> np.ndarray:
    bits = np.zeros(128, np.uint8)
    bits[(differences >> U64(57)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _comparer(least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, PAIRS) for whole in batches for i in range(0, whole.num_rows, PAIRS)):
            hubs, nodes = batch.column("hub_elements"), batch.column("node_elements")
            out: dict[str, list] = {c: [] for c in ("linked", "g", "bound", "differences", "bits0", "bits1")}
            for h, x in zip(hubs, nodes):
                h, x = np.frombuffer(h.as_buffer(), U64), np.frombuffer(x.as_buffer(), U64)
                yes, shared = linked(h, x, least)
                added, missing = x[~shared], np.setdiff1d(h, x[shared], assume_unique=True)
                differences = np.concatenate([mix(added), mix(missing ^ _MISSING)])
                bits = _bitmap(differences)
                for c, v in zip(out, (yes, 100 * len(missing) + least * len(added), (100 - least) * len(h), differences.view(np.int64), bits[0], bits[1])):
                    out[c].append(v)
            names = ["hub", "node"]
            yield pa.record_batch([*(batch.column(c) for c in names), *(pa.array(v, t) for v, t in zip(out.values(), _KINDS))], [*names, *out])

    return run


_MISSING = U64(0xD1B54A32D192ED03)
_KINDS = (pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64())


def _compared(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    side = lambda to: sets.select(F.col("id").alias(to), F.col("elements").alias(f"{to}_elements"))
    both = pairs.join(side("node"), "node").join(side("hub"), "hub")
    out = "hub long, node long, linked boolean, g long, bound long, differences array<long>, bits0 long, bits1 long"
    return cut(both.select("hub", "node", "hub_elements", "node_elements").mapInArrow(_comparer(least), out))


def _small(df: DataFrame) -> DataFrame:
    """A written table of numbers, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() * 8 * len(df.columns) <= MAX_BROADCAST else df


def _labelled(rows: DataFrame, labels: DataFrame, of: str, name: str) -> DataFrame:
    return rows.join(labels.select(F.col("a").alias(of), F.col("b").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))


def _placed(compared: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their component and their hub's, of hubs that have members apart."""
    rows = _labelled(_labelled(compared, labels, "node", "own"), labels, "hub", "hubs").withColumn("apart", F.col("own") != F.col("hubs")).drop("hubs", "linked")
    return cut(rows.join(rows.filter("apart").select("hub").distinct(), "hub", "left_semi"))


def _shared(pairs: DataFrame, placed: DataFrame, least: int) -> DataFrame:
    """The links among ``pairs(hub, x, y)``, by the members' differences from the hub."""
    side = lambda to: placed.select("hub", "bound", *[F.col(c).alias(f"{to}_{c}") for c in ("node", "g", "differences")]).withColumnRenamed(f"{to}_node", to)
    both = pairs.join(side("x"), ["hub", "x"]).join(side("y").drop("bound"), ["hub", "y"])
    n = F.size(F.array_intersect("x_differences", "y_differences"))
    return both.filter(n * (100 + least) >= F.col("x_g") + F.col("y_g") - F.col("bound")).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _closest(placed: DataFrame) -> DataFrame:
    """``(hub, element)``: how many members have a difference, and the one of them that is closest to the hub."""
    each = placed.select("hub", F.explode("differences").alias("element"), F.struct("g", "node").alias("of"))
    return cut(each.groupBy("hub", "element").agg(F.count("*").alias("n"), F.min("of").alias("closest")).select("hub", "element", "n", F.col("closest.node").alias("closest")))


def _met_by_closest(placed: DataFrame, elements: DataFrame) -> DataFrame:
    mine = placed.filter("apart").select("hub", F.col("node").alias("y"), F.explode("differences").alias("element"))
    return mine.join(elements, ["hub", "element"]).filter("closest != y").select("hub", F.col("closest").alias("x"), "y").distinct()


def residual(placed: DataFrame, elements: DataFrame, least: int) -> DataFrame:
    """``(hub, x, y)``: the pairs of different components, ``y`` apart from the hub, that may share enough differences."""
    each = placed.select("hub", "node", F.explode("differences").alias("element")).join(elements.select("hub", "element", "n"), ["hub", "element"])
    order = each.groupBy("hub", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "element"))), lambda e: e["element"]).alias("order"))
    due = 100 + least
    rows = placed.drop("differences").join(order, ["hub", "node"]).withColumn("size", F.size("order"))
    met, meets = F.floor(F.col("g") / due) + 1, F.ceil((F.col("g") - F.col("bound")) / due)
    head = lambda to, of, share: of.select("hub", F.posexplode(F.slice("order", F.lit(1), F.greatest(F.lit(0), F.col("size") - share + 1).cast("int"))).alias("at", "element"), *_MEMBER).select("hub", "element", *[F.col(c).alias(f"{to}_{c}") for c in ("at", *_MEMBER)])
    y = head("y", rows.filter("apart"), meets)
    both = y.join(head("x", rows, met).drop("x_bound"), ["hub", "element"])
    need = f"(x_g + y_g - y_bound) <= {due} * "
    differing = "bit_count(x_bits0 ^ y_bits0) + bit_count(x_bits1 ^ y_bits1)"
    fit = both.filter(f"x_own != y_own and (not x_apart or x_node < y_node) and {need} least(x_size - x_at, y_size - y_at) and 2 * {need} (x_size + y_size - ({differing}))")
    return fit.select("hub", F.col("x_node").alias("x"), F.col("y_node").alias("y")).distinct()


_MEMBER = ("node", "own", "apart", "g", "bound", "size", "bits0", "bits1")


def group(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """``docs(doc_id long, text)`` to ``(doc_id, text_key, n_shingles, component_id, kept)``; ``text_key`` is a hash of the text."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    signed = cut(keyed.mapInArrow(_signer(shingle, bands_for(least)), "doc_id long, text_key long, n_shingles long, node binary, bands array<long>"))
    known = signed.filter("node is not null and doc_id is not null")
    classes = cut(known.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()))

    rows = classes.select("id", F.explode("bands").alias("bucket"))
    sizes = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    members = cut(rows.join(_small(sizes), "bucket"))
    release(docs.sparkSession)  # of the rows of all bands
    members = members.join(members.groupBy("id").agg(F.sum("n").alias("weight")), "id")
    hubs = members.groupBy("bucket").agg(F.max(F.struct("weight", "id")).alias("h")).select("bucket", F.col("h.id").alias("hub"))
    pairs = cut(members.join(hubs, "bucket").filter("hub != id").select("hub", F.col("id").alias("node")).distinct())

    used = pairs.select(F.col("hub").alias("id")).unionByName(pairs.select(F.col("node").alias("id"))).distinct()
    wanted = cut(classes.select("id", "node", "rep").join(used, "id"))
    ids = _small(cut(wanted.select(F.col("rep").alias("doc_id")).distinct()))  # if not broadcast, the texts are shuffled
    named = docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets(shingle), "node binary, elements binary")
    sets = cut(named.filter("node is not null").groupBy("node").agg(F.first("elements").alias("elements")).join(wanted, "node").select("id", "elements"))
    release(docs.sparkSession)  # of the texts and sets
    compared = _compared(pairs, sets, least)
    release(docs.sparkSession)
    labels = components(compared.filter("linked").select(F.col("hub").alias("a"), F.col("node").alias("b")))

    placed = _placed(compared, labels)
    if not placed.isEmpty():
        elements = _closest(placed)
        labels = joined(labels, cut(_shared(_met_by_closest(placed, elements), placed, least)))
        placed = _placed(placed.drop("own", "apart"), labels)
        late = cut(_shared(residual(placed, elements, least), placed, least))
        if not late.isEmpty():
            labels = joined(labels, late)

    ends = labels.unionByName(labels.select(F.col("b").alias("a"), "b").distinct()).join(classes.select(F.col("id").alias("a"), "node", "rep"), "a")
    named_by = ends.groupBy("b").agg(F.min("rep").alias("component_id"))
    component = cut(ends.join(named_by, "b").select("node", "component_id"))
    component = classes.select("node", "rep").join(component, "node", "left").select("node", F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.select("doc_id", "text_key", "n_shingles", "node").join(component, "node", "left")
    component_id = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_key", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """``docs`` with one row of each group, all columns. Of rows equal in doc_id and text that stays whose other columns come
    first by a hash, so reruns agree."""
    kept = group(docs, shingle, least).filter("kept").select(F.struct(F.col("doc_id"), F.col("text_key")).alias("_row")).distinct()
    own = docs.withColumn("_row", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key")))
    nth = F.row_number().over(Window.partitionBy("_row").orderBy(row_hash(docs)))
    return own.join(kept, "_row", "left_semi").withColumn("_nth", nth).filter("_nth = 1").drop("_row", "_nth")
