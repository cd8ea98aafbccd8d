"""Near duplicates by HyperMinHash.

Each register of a sketch is the minimum of a seeded permutation of the shingle hashes, kept as the
number of its leading zeros (6 bits) and the ten bits that follow the leading one. Every register sees
every shingle (each bucket has its own permutation), since a short document would leave buckets of a
single split permutation empty. Four registers make a band of exactly 64 bits, so the sketch of 128
registers *is* its 32 band keys. Documents of the same band meet, the estimate of their registers,
corrected for the chance collisions that the compression adds, drops the far ones, and exact
intersections of the full shingle sets confirm the rest.

Copies (equal shingle sets) form one class before any of this. Within a band bucket every member is
paired with one hub only; members that this leaves in different components are compared in blocks of
bounded size, the largest component of a bucket with the others and these with each other, by sketches first
and then, what these leave, by full sets; a block returns only the links that join components. So no
bucket is cut short, and none is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepforge.llm.common import kept, likely, mixed, ready, seeded, text_slices, texts_of
from stepforge.llm.words import shingle_sets

WIDTH, REGISTERS, ROWS_PER_BAND, MANTISSA = 5, 128, 4, 10
BANDS = REGISTERS // ROWS_PER_BAND
#: A pair goes to the exact check if its estimate is at least the threshold less this many standard errors.
SLACK = 5.5
#: Members of a bucket that one task compares with each other at a time.
BLOCK = 256

_PERMUTATIONS = seeded(REGISTERS, 21) | np.uint64(1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of compressed registers for each set that is not empty."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    starts = np.zeros(len(sets), dtype=np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=starts[1:])
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    for k, odd in enumerate(_PERMUTATIONS):
        least = np.minimum.reduceat(flat * odd, starts) >> np.uint64(11)  # 53 bits, exact as a double
        bits = np.frexp(least.astype(np.float64))[1].astype(np.int64)
        over = np.maximum(bits - 1 - MANTISSA, 0).astype(np.uint64)
        under = np.maximum(MANTISSA + 1 - bits, 0).astype(np.uint64)
        tail = ((least >> over) << under) & np.uint64((1 << MANTISSA) - 1)
        out[:, k] = ((53 - bits) << MANTISSA).astype(np.uint16) | tail.astype(np.uint16)
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that a register of disjoint sets of n and m shingles is equal by compression alone."""
    levels = np.arange(54)
    tall, low = 1 - 0.5 ** (levels + 1.0), 1 - 0.5**levels

    def at(k: np.ndarray) -> np.ndarray:
        k = np.asarray(k, dtype=np.float64)[:, None]
        return tall**k - low**k

    return (at(n) * at(m)).sum(axis=1) / (1 << MANTISSA)


def corrected(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the share of equal registers."""
    c = chance(n, m)
    return (equal - c) / (1 - c)


def _floor(threshold: float) -> float:
    return threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))


SKETCH = "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        sets = shingle_sets(part.column("text").to_pylist(), WIDTH)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        full = np.flatnonzero(sizes)
        bands = np.zeros((len(sets), BANDS), dtype=np.int64)
        digests = np.zeros((len(sets), 2), dtype=np.uint64)
        if len(full):
            some = [sets[i] for i in full]
            bands[full] = registers(some).view(np.int64)
            flat, at = np.concatenate(some), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            digests[full, 0] = mixed(np.add.reduceat(mixed(flat), at))
            digests[full, 1] = mixed(np.bitwise_xor.reduceat(mixed(flat + np.uint64(1)), at) + sizes[full].astype(np.uint64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(sizes), *(pa.array(digests[:, i].view(np.int64), mask=sizes == 0) for i in (0, 1)), lists],
            names=["doc_id", "n_shingles", "digest_a", "digest_b", "bands"],
        )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, size and 128-bit digest of the shingle set, and the band keys, for every row: null digests for a null or wordless text, equal ones for equal sets."""
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketched, SKETCH)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        sets = [s.view(np.int64) for s in shingle_sets(part.column("text").to_pylist(), WIDTH)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, type=pa.list_(pa.int64()))], names=["doc_id", "shingles"])


def _lanes(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, BANDS).view(np.uint16)


def _close(threshold: float):
    floor = _floor(threshold)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            equal = (_lanes(b.column("bands_a")) == _lanes(b.column("bands_b"))).mean(axis=1)
            near = corrected(equal, np.asarray(b.column("n_a")), np.asarray(b.column("n_b"))) >= floor
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(near)) for c in ("a", "b")], names=["a", "b"])

    return keep


def _alike_sizes(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(threshold)


def _close_pairs(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose sizes and corrected estimate allow the threshold."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bands").alias(f"bands_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(_alike_sizes(F.col("n_a"), F.col("n_b"), threshold))
    return both.select("a", "b", "n_a", "n_b", "bands_a", "bands_b").mapInArrow(_close(threshold), "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id and full shingle set of the documents of ids (doc_id)."""
    ids = kept(ids, "near-ids")
    return kept(texts_of(docs, ids).mapInArrow(_set_rows, "doc_id long, shingles array<long>"), "near-sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets have 100 * intersection >= percent * union; pairs must be a kept table."""
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs)
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}"))
    common = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a") + F.size("set_b") - common
    return pairs.join(side("b"), "b").join(side("a"), "a").filter(100 * common >= percent * union).select("a", "b")


def _buckets(reps: DataFrame) -> DataFrame:
    """A row (bucket, rep) for each band of each class."""
    return reps.select("rep", F.posexplode("bands").alias("band", "key")).select("rep", "band", F.xxhash64("band", "key").alias("bucket"))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _candidates(group: pa.Table, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each left member of a group the right ones in other components whose sizes and sketches allow a link."""
    rep, n, band, comp, left = (np.asarray(group.column(c)) for c in ("rep", "n_shingles", "band", "comp", "left"))
    bands = np.asarray(group.column("bands").combine_chunks().flatten()).reshape(-1, BANDS)
    lanes, floor = bands.view(np.uint16), _floor(threshold)
    right = np.flatnonzero(np.asarray(group.column("right")))
    for x in np.flatnonzero(left):
        y = right[(comp[right] != comp[x]) & (rep[right] != rep[x])]
        y = y[np.minimum(n[y], n[x]) >= np.maximum(n[y], n[x]) * threshold]
        y = y[(bands[y] == bands[x]).argmax(axis=1) == band[x]]  # a pair is compared in the first band it shares
        if len(y):
            y = y[corrected((lanes[y] == lanes[x]).mean(axis=1), np.full(len(y), n[x]), n[y]) >= floor]
        if len(y):
            yield int(x), y


def _survivors(percent: int):
    """The members of a group that have a candidate."""

    def survive(group: pa.Table) -> pa.Table:
        some = np.zeros(group.num_rows, dtype=bool)
        for x, y in _candidates(group, percent / 100):
            some[x] = True
            some[y] = True
        return group.filter(pa.array(some))

    return survive


def _blocks(percent: int):
    """Links between members of a group that are not in one component yet; of these, as many as join them."""

    def compare(group: pa.Table) -> pa.Table:
        rep, n = (np.asarray(group.column(c)) for c in ("rep", "n_shingles"))
        comp = np.unique(np.asarray(group.column("comp")), return_inverse=True)[1]
        lists = group.column("shingles").combine_chunks()
        flat, ends = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets) - lists.offsets[0].as_py()
        sets = [flat[ends[k] : ends[k + 1]] for k in range(len(rep))]
        found: list[tuple[int, int]] = []
        for x, y in _candidates(group, percent / 100):
            for k in y:
                if comp[k] == comp[x]:
                    continue
                both = _common(sets[x], sets[k])
                if 100 * both >= percent * (n[x] + n[k] - both):
                    found.append((min(rep[x], rep[k]), max(rep[x], rep[k])))
                    comp[comp == comp[k]] = comp[x]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


_MEMBER = "bucket long, band int, rep long, comp long, n_shingles long, bands array<long>, i int, j int, left boolean, right boolean"


def _open_members(reps: DataFrame, hubs: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components beside their hub, with their block among those of the
    bucket's largest component (main), or among all others; mains and others are the numbers of these blocks."""
    members = _buckets(reps).join(hubs.filter("members > 2"), "bucket").filter("rep <> hub").select("bucket", "band", "rep")
    members = kept(members.join(labels, F.col("rep") == F.col("id"), "left").select("bucket", "band", "rep", F.coalesce("comp", "rep").alias("comp")), "near-members")
    sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    several = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("k"), F.count("*").alias("comps")).filter("comps > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    several = several.select("bucket", F.col("most.comp").alias("largest"), blocks(F.col("most.n")).alias("mains"), blocks(F.col("k") - F.col("most.n")).alias("others"))
    rows = members.join(several, "bucket").withColumn("main", F.col("comp") == F.col("largest"))
    return kept(rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).cast("int")), "near-open")


def _left_over(open_: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links of bucket members that are still in different components.

    A link between components has an end outside the bucket's largest one. So blocks of the others meet each other and
    the blocks of the largest component, whose members are copied once for each block of others only. Sketches meet
    first; full sets are fetched for, and sent to, what they leave."""
    rows = open_.join(reps.select("rep", "n_shingles", "bands"), "rep")
    # group (i, j): others' block i with others' block j >= i, or with block -1 - j of the largest component
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    with_others = F.transform(upto(F.col("others")), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), (F.col("block") <= o).alias("left"), (F.col("block") >= o).alias("right")))
    with_mains = F.transform(upto(F.col("mains")), lambda m: F.struct(F.col("block").alias("i"), (-1 - m).alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right")))
    of_mains = F.transform(upto(F.col("others")), lambda o: F.struct(o.alias("i"), (-1 - F.col("block")).alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right")))
    rows = rows.select("bucket", "band", "rep", "comp", "n_shingles", "bands", F.inline(F.when(F.col("main"), of_mains).otherwise(F.concat(with_others, with_mains))))
    rows = kept(rows.groupBy("bucket", "i", "j").applyInArrow(_survivors(percent), _MEMBER), "near-survivors")
    if rows.isEmpty():
        return rows.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    sets = _sets(rows.select(F.col("rep").alias("doc_id")).distinct(), docs).select(F.col("doc_id").alias("rep"), "shingles")
    return rows.join(sets, "rep").groupBy("bucket", "i", "j").applyInArrow(_blocks(percent), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, comp (smallest id of its component) for every id of links (a, b): alternating large and small stars.

    Each round joins every edge to the least neighbour of its end; rounds grow with the logarithm of the ids. Repeated
    links and links of an id with itself count for nothing; no links give no rows."""
    edges = kept(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if not seen[0] or seen == before:
            break
        before = seen
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(floor, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = kept(small.filter("u <> v").distinct(), "stars")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct())


def _same_ids(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the classes of texts that have one doc_id."""
    several = rows.groupBy("doc_id").agg(F.min("digest_a").alias("lo"), F.max("digest_a").alias("hi")).filter("lo <> hi").select("doc_id")
    several = kept(several, "near-several")
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    digests = ["digest_a", "digest_b"]
    of = rows.join(several, "doc_id").select("doc_id", *digests).distinct().join(reps.select(*digests, "rep"), digests).select("doc_id", "rep")
    return of.groupBy("doc_id").agg(F.min("rep").alias("a")).join(of, "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs.

    Documents are linked if 100 * intersection >= percent * union of their sets of 5-word shingles;
    component_id is the least doc_id that links reach. Null and wordless texts have no shingles and no
    links. Columns other than doc_id and text are not read. A row without doc_id takes no part in
    links: its component_id is null and it is kept. Repeated rows are copies of one class; rows that repeat
    a doc_id with other texts are one document with the links of all its texts. An empty table gives an
    empty result.
    """
    threshold = percent / 100
    all_rows = kept(sketches(docs), "near-sketches")
    rows = all_rows.filter("n_shingles > 0 and doc_id is not null")
    classes = rows.groupBy("digest_a", "digest_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    reps = kept(classes, "near-classes")
    hubs = _buckets(reps).groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("members")).filter("members > 1")
    hubs = kept(hubs, "near-hubs")
    pairs = _buckets(reps).join(hubs, "bucket").filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = _confirmed(kept(_close_pairs(pairs, reps, threshold), "near-pairs"), docs, percent)
    links = kept(links.union(_same_ids(rows, reps)), "near-links")
    labels = components(links)
    more = kept(_left_over(_open_members(reps, hubs, labels), reps, docs, percent), "near-more")
    if not more.isEmpty():
        labels = components(links.union(more))
    changed = reps.join(labels, F.col("rep") == F.col("id"), "left").select("digest_a", "digest_b", F.coalesce("comp", "rep").alias("comp"), "copies", "rep").filter("copies > 1 or comp <> rep")
    of = rows.join(changed, ["digest_a", "digest_b"], "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    bare = all_rows.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return of.union(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_each(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs, all columns, without near duplicates of a kept document; of rows that repeat a doc_id the one with the least hash of its text stays.

    All columns travel as one struct, so none of them can clash with a name used here."""
    found = kept(near_duplicates(docs, percent).select("doc_id", "kept"), "near-found")
    gone = kept(found.filter("not kept").select("doc_id").distinct(), "near-gone")
    has = likely(gone.select(F.xxhash64("doc_id").alias("hash")), "hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    may_go = has(F.xxhash64("doc_id"))
    rest = rows.filter(~may_go).unionByName(rows.filter(may_go).join(gone, "doc_id", "left_anti"))
    repeated = kept(found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "near-repeated")
    if repeated.isEmpty():
        return rest.select("row.*")
    order = F.struct(F.xxhash64("row.text"), F.to_json("row"))
    once = rest.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("row", order).alias("row"))
    return rest.join(repeated, "doc_id", "left_anti").unionByName(once).select("row.*")
