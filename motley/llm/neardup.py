"""Operator 4, MinHash near-dedup by HyperMinHash registers.

1. *Sketch.*  Each text becomes its set of 64-bit hashes of five-word shingles.
   Bucket k holds the least value of its own hash of all shingles, compressed
   as HyperMinHash does: the number of leading zeros and ten mantissa bits.
   (Each bucket hashes every shingle; splitting few shingles over many buckets
   would leave most of them empty on short texts.)
2. *Classes.*  Equal sets are one class; only one document of a class goes on.
3. *Bands.*  24 bands of three registers.  In each band value the least and the
   greatest id are representatives; all members are paired with these two, so a
   group of n near copies gives 2n pairs, not n**2.
4. *Estimate.*  Equal registers, less the equalities expected by chance for the
   two set sizes, estimate the similarity; pairs of at least ``CLOSE`` go on.
5. *Verification* on full sets, in rounds: every document is compared with the
   most similar one outside its component, linked components become one, and
   pairs inside a component need no further look.  What is left after two
   rounds is verified whole.
6. *The rest.*  Band values whose members are still in several components are
   searched again: registers of members of different components are compared in
   tiles of ``TILE``, and members with a pair of at least ``CLOSE`` are *open*.
   Of an open member the shingles that no other open member has are counted;
   what is left bounds its intersection with anyone, and members without a pair
   that this bound admits are closed again (a far edited copy has too many
   shingles of its own).  The others are paired by an exact prefix filter: their
   shingles are ordered from rare to frequent, and a pair that is linked shares
   one among the first n - ceil(3/7 (n + m)) + 1 of both.  Pairs of different
   components that do are verified as in 5.

So a linked pair is missed only if it shares no band value (2e-6 at exactly 0.75)
or has an estimate below ``CLOSE`` (1e-6).  Rows move as ids, registers (144
bytes) and, for pairs under verification, a shingle set for each end; a group of
n near copies costs O(n) of them.  Only open members that pass the bound send
single shingles, and only those that share rare ones are paired.

Edge cases: null or blank texts have empty sets and link to nothing; texts of
one to four words are one shingle; texts of any length are hashed in whole, in
slices of 2048 shingles; rows with a null doc_id are kept, unlinked, with a null
component; rows sharing a doc_id count as one document holding several texts;
repeated rows stay repeated; ties go to the smaller id; an empty table gives no
rows; other columns are ignored, and pass through ``apply`` whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motley.llm import textbytes as tb
from motley.llm.shared import components, unused, written
from motley.session import ship

BANDS, ROWS, MANTISSA, CLOSE, TILE = 24, 3, 10, 0.5, 512
CHOICE_ROUNDS = 2
#: Ids of documents that are looked up by broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_IDS = 1 << 21

_U = np.uint64
_K = np.arange(1, BANDS * ROWS + 1, dtype=_U)
_XOR = tb.mix(_K * _U(0x9E3779B97F4A7C15))
_MUL = tb.mix(_K * _U(0xC2B2AE3D27D4EB4F)) | _U(1)
_BAND = tb.mix(np.arange(1, BANDS + 1, dtype=_U) * _U(0x165667B19E3779F9))


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16: leading zeros, then mantissa bits) of a set of 64-bit hashes."""
    least = np.full(len(_K), ~_U(0))
    for at in range(0, len(shingles), 2048):
        np.minimum(least, ((shingles[at : at + 2048, None] ^ _XOR) * _MUL).min(axis=0), out=least)
    high = least >> _U(11)  # 53 bits: exact as doubles
    length = np.frexp(high.astype(np.float64))[1]
    shift = np.maximum(length - 1 - MANTISSA, 0)
    mantissa = (high >> shift.astype(_U)) & _U((1 << MANTISSA) - 1)
    return (((53 - length).astype(_U) << _U(MANTISSA)) | mantissa).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    parts = regs.astype(_U).reshape(BANDS, ROWS)
    return tb.mix((parts[:, 0] | (parts[:, 1] << _U(16)) | (parts[:, 2] << _U(32))) ^ _BAND).view(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of equal registers of two disjoint sets of n and m elements.

    Both minima fall into one register cell of width w(x) = 2**floor(log2 x) / 2**MANTISSA,
    on average 0.72 x / 2**MANTISSA, with density n m exp(-(n + m) x).
    """
    return 0.72 / (1 << MANTISSA) * n * m / np.maximum(n + m, 1.0) ** 2


def estimate(a: list[bytes], b: list[bytes], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarities of pairs by their registers, less what chance makes equal."""
    left, right = (np.frombuffer(b"".join(x), np.uint16).reshape(len(x), BANDS * ROWS) for x in (a, b))
    by_chance = chance(n.astype(float), m.astype(float))
    return ((left == right).mean(axis=1) - by_chance) / (1 - by_chance)


def close_pairs(batches):
    """Arrow kernel: pairs (x, y) with registers and sizes to those with an estimate of ``CLOSE`` or more."""
    for batch in batches:
        regs, sizes = ([batch.column(f"{c}_{end}") for end in "xy"] for c in ("regs", "n"))
        near = estimate(*(r.to_pylist() for r in regs), *(n.to_numpy() for n in sizes))
        keep = pa.array(near >= CLOSE)
        yield pa.RecordBatch.from_arrays([batch.column("x").filter(keep), batch.column("y").filter(keep), pa.array(near[near >= CLOSE])], names=["x", "y", "near"])


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketch(batches):
    """Arrow kernel: set size, digest of the set, registers and band keys of each text."""
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        for i, j, words in tb.each_slice(batch.column("text"), lower=True):
            sizes, digests, regs, keys = [], [], [], []
            for shingles in words.shingle_sets():
                sizes.append(len(shingles))
                digests.append(_digest(shingles))
                r = registers(shingles)
                regs.append(r.tobytes() if len(shingles) else b"")
                keys.append(band_keys(r) if len(shingles) else np.zeros(0, np.int64))
            cuts = np.cumsum([0, *map(len, keys)])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(keys), pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "regs", "bands"],
            )


def shingle_sets(batches):
    """Arrow kernel: (id, body) to (id, digest, shingles), the sorted hashes as bytes."""
    for batch in batches:
        ids = batch.column("id")
        for i, j, words in tb.each_slice(batch.column("body"), lower=True):
            sets = words.shingle_sets()
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(map(_digest, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "digest", "shingles"])


def single_shingles(batches):
    """Arrow kernel: (digest, shingles) to one row (digest, size, shingle) for each hash."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        at = 0
        while at < len(sets):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 17), "right")) - 1)
            owner = np.repeat(np.arange(at, to), sizes[at:to])
            yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(owner)), pa.array(sizes[owner]), pa.array(np.concatenate(sets[at:to]))], names=["digest", "size", "shingle"])
            at = to


def linked(a: bytes, b: bytes) -> bool:
    """Whether 100 * intersection >= 75 * union holds for two sorted sets of hashes."""
    n = (len(a) + len(b)) // 8
    if 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
        return False
    both = np.concatenate((np.frombuffer(a, _U), np.frombuffer(b, _U)))
    both.sort(kind="stable")  # two sorted runs: a merge
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (n - common)


def _verified(batches):
    """Arrow kernel: of pairs of components with a shingle set for each end those that are linked."""
    for batch in batches:
        keep = [linked(a, b) for a, b in zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("lx", "ly")], names=["a", "b"])


def likenesses(regs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The estimates between all rows of registers."""
    if len(regs) <= 48:
        equal = (regs[:, None, :] == regs[None, :, :]).sum(axis=2)
    else:
        equal = np.zeros((len(regs), len(regs)), np.uint8)
        for column in np.ascontiguousarray(regs.T):
            equal += column[:, None] == column[None, :]
    sizes = sizes.astype(np.float32)
    by_chance = chance(sizes[:, None], sizes[None, :])
    return (equal.astype(np.float32) / np.float32(regs.shape[1]) - by_chance) / (1 - by_chance)


def _groups(batches, keys: list[str], values: list[str]):
    """For each batch the runs of equal keys that end in it: lists of value tuples, rows being sorted by key."""
    now, rows = None, []
    for batch in batches:
        ended = []
        for key, row in zip(zip(*(batch.column(c).to_pylist() for c in keys)), zip(*(batch.column(c).to_pylist() for c in values))):
            if key != now:
                ended.append(rows)
                now, rows = key, []
            rows.append(row)
        yield ended
    yield [rows]


_TILE_KEY = ["key", "low", "high"]


def open_members(batches):
    """Arrow kernel over tiles: members with a pair of another component whose estimate is ``CLOSE`` or more and whose sizes allow a link."""
    for groups in _groups(batches, _TILE_KEY, ["id", "label", "regs", "n_shingles", "most"]):
        found = [np.zeros(0, np.int64)]
        for rows in groups:
            labels = np.array([r[1] for r in rows])
            if len(rows) > 1 and (labels != labels[0]).any():
                sizes, most = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
                near = likenesses(np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(len(rows), -1), sizes)
                fits = (near >= CLOSE) & (labels[:, None] != labels[None, :])
                fits &= 7 * np.minimum(most[:, None], most[None, :]) >= 3 * (sizes[:, None] + sizes[None, :])
                found.append(np.array([r[0] for r in rows])[fits.any(axis=1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], names=["id"])


def prefixes(batches):
    """Arrow kernel over rows (digest, size, n, shingle), sorted: the places of a set's shared shingles from rare to frequent,
    up to the last that a link can depend on."""
    for groups in _groups(batches, ["digest"], ["digest", "size", "shingle"]):
        out = []
        for rows in filter(None, groups):
            size = rows[0][1]
            alone = size - len(rows)  # these come first, and nobody shares them
            last = size - -(-3 * size // 4)
            out += [(digest, alone + k, size, shingle) for k, (digest, _, shingle) in enumerate(rows[: max(0, last - alone + 1)])]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int64()))], names=["digest", "place", "size", "shingle"])


def prefix_pairs(batches):
    """Arrow kernel over tiles: pairs (x, y, near) of different components that share a shingle inside both prefixes."""
    for groups in _groups(batches, _TILE_KEY, ["id", "label", "place", "size"]):
        found = [np.zeros((0, 2), np.int64)]
        for rows in groups:
            if len(rows) > 1:
                ids, labels, place, size = np.array(rows).T
                overlap = -(-3 * (size[:, None] + size[None, :]) // 7)
                fits = (labels[:, None] != labels[None, :]) & (ids[:, None] < ids[None, :]) & (place[:, None] <= size[:, None] - overlap) & (place[None, :] <= size[None, :] - overlap)
                x, y = np.nonzero(fits)
                found.append(np.stack((ids[x], ids[y]), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(np.zeros(len(pairs)))], names=["x", "y", "near"])


def _named(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with their components lx and ly, where these differ."""
    for end in ("x", "y"):
        pairs = pairs.join(labels.select(F.col("id").alias("of"), F.col("label").alias(f"l{end}")), F.col(end) == F.col("of")).drop("of")
    return pairs.where("lx <> ly")


def _choice(pairs: DataFrame) -> DataFrame:
    """The most similar pair of each document."""
    ends = pairs.select(F.col("x").alias("at"), F.col("y").alias("other"), "near", "lx", "ly").union(pairs.select("y", "x", "near", "lx", "ly"))
    best = ends.groupBy("at").agg(F.max(F.struct("near", (-F.col("other")).alias("other"), "lx", "ly")).alias("best"))
    other = -F.col("best.other")
    return best.select(F.least("at", other).alias("x"), F.greatest("at", other).alias("y"), "best.lx", "best.ly").dropDuplicates(["x", "y"])


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, digest, shingles) of the documents in ``nodes`` (one column of ids)."""
    body = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").alias("body")).where("body IS NOT NULL")
    nodes = nodes.toDF("node")
    if nodes.count() <= BROADCAST_IDS:
        nodes = F.broadcast(nodes)
    body = body.join(nodes, F.col("id") == F.col("node"), "left_semi")
    return body.mapInArrow(shingle_sets, "id long, digest binary, shingles binary").dropDuplicates(["id", "digest"])


def _settle(docs: DataFrame, pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (id, label) after every pair (x, y, near) was verified or found inside a component."""
    pairs = written(_named(pairs, labels), "pairs")
    if pairs.isEmpty():
        return labels
    sets = written(_sets(docs, written(pairs.select("x").union(pairs.select("y")).distinct(), "nodes")).drop("digest"), "sets")
    side = lambda end: sets.select(F.col("id").alias(f"id_{end}"), F.col("shingles").alias(f"s{end}"))
    for k in range(CHOICE_ROUNDS + 1):
        chosen = written(_choice(pairs), "choice") if k < CHOICE_ROUNDS else pairs
        both = chosen.select("x", "y", "lx", "ly").join(side("x"), F.col("x") == F.col("id_x")).join(side("y"), F.col("y") == F.col("id_y"))
        found = written(both.select("lx", "ly", "sx", "sy").mapInArrow(_verified, "a long, b long").distinct(), "links")
        if not found.isEmpty():
            joined = components(found).select("node", F.col("label").alias("new"))
            labels = written(labels.join(joined, F.col("label") == F.col("node"), "left").select("id", F.coalesce("new", "label").alias("label")), "components")
        if k < CHOICE_ROUNDS:
            left = pairs.join(chosen.select(F.col("x").alias("p"), F.col("y").alias("q")), (F.col("x") == F.col("p")) & (F.col("y") == F.col("q")), "left_anti")
            pairs = written(_named(left.select("x", "y", "near"), labels), "pairs")
            if pairs.isEmpty():
                break
    return labels


def _tiles(rows: DataFrame) -> DataFrame:
    """(key, id, label, ...) of the keys with several components, dealt out by tiles (key, low, high) and sorted by them."""
    rows = written(rows, "rows")
    several = rows.groupBy(F.col("key").alias("of")).agg(F.min("label").alias("least"), F.max("label").alias("last"), F.count(F.lit(1)).alias("n")).where("least < last").select("of", F.ceil(F.col("n") / TILE).cast("long").alias("tiles"))
    split = rows.join(several, F.col("key") == F.col("of")).drop("of").withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")))
    others = F.when(F.col("tiles") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda t: t != F.col("own")))
    tiled = split.withColumn("other", F.explode(others)).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("own", "other", "tiles")
    return tiled.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_TILE_KEY).sortWithinPartitions(*_TILE_KEY)


def _open(members: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Ids of the open members; ``reps``: of, regs, n_shingles, most."""
    rows = members.select("id", F.col("band").alias("key")).join(labels.withColumnRenamed("id", "of"), F.col("id") == F.col("of")).select("key", "id", "label")
    rows = rows.join(reps, F.col("id") == F.col("of")).drop("of")
    return written(_tiles(rows).mapInArrow(open_members, "id long").distinct(), "open")


def _rest(docs: DataFrame, rep: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (x, y, near) that step 6 leaves for verification."""
    reps = rep.select(F.col("doc_id").alias("of"), "regs", "n_shingles", F.col("n_shingles").alias("most"))
    sets = written(_sets(docs, _open(members, labels, reps)), "sets")
    singles = lambda s: s.select("digest", "shingles").mapInArrow(single_shingles, "digest binary, size long, shingle long")
    alone = singles(sets).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("only")).where("n = 1").groupBy("only").agg(F.count(F.lit(1)).alias("n_alone"))
    known = rep.join(sets.select(F.col("digest").alias("there")), F.col("digest") == F.col("there"), "left_semi").join(alone, F.col("digest") == F.col("only"), "left")
    known = written(known.select(F.col("doc_id").alias("of"), "regs", "n_shingles", (F.col("n_shingles") - F.coalesce("n_alone", F.lit(0))).alias("most")), "bounds")
    opened = _open(members, labels, known).withColumnRenamed("id", "node")

    few = written(sets.join(opened, F.col("id") == F.col("node"), "left_semi"), "sets")
    often = singles(few).groupBy(F.col("shingle").alias("of")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = singles(few).join(often, F.col("shingle") == F.col("of")).select("digest", "size", "n", "shingle")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prefix = shared.repartition(parts, "digest").sortWithinPartitions("digest", "n", "shingle").mapInArrow(prefixes, "digest binary, place long, size long, shingle long")
    named = few.select(F.col("digest").alias("of"), "id").join(labels.withColumnRenamed("id", "node"), F.col("id") == F.col("node"))
    rows = prefix.join(named, F.col("digest") == F.col("of")).select(F.col("shingle").alias("key"), "id", "label", "place", "size")
    return _tiles(rows).mapInArrow(prefix_pairs, "x long, y long, near double").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (plus class_id, the least id with the same set)."""
    spark = docs.sparkSession
    ship(spark)
    all_rows = written(docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n_shingles long, digest binary, regs binary, bands array<long>"), "sketches")
    filled = all_rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = written(filled.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    rep = written(filled.join(classes.withColumnRenamed("digest", "of"), (F.col("digest") == F.col("of")) & (F.col("doc_id") == F.col("rep")), "left_semi").dropDuplicates(["digest"]), "reps")

    banded = rep.select(F.col("doc_id").alias("id"), F.explode("bands").alias("band"))
    ends = banded.groupBy(F.col("band").alias("key")).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    members = written(banded.join(ends, F.col("band") == F.col("key")).select("id", "band", "first", "last"), "members")
    pairs = members.select("id", F.explode(F.array("first", "last")).alias("hub")).where("id <> hub")
    pairs = pairs.select(F.least("id", "hub").alias("x"), F.greatest("id", "hub").alias("y")).distinct()
    side = lambda k: rep.select(F.col("doc_id").alias(f"id_{k}"), F.col("regs").alias(f"regs_{k}"), F.col("n_shingles").alias(f"n_{k}"))
    judged = pairs.join(side("x"), F.col("x") == F.col("id_x")).select("x", "y", "regs_x", "n_x").join(side("y"), F.col("y") == F.col("id_y"))
    close = judged.select("x", "y", "regs_x", "regs_y", "n_x", "n_y").mapInArrow(close_pairs, "x long, y long, near double")
    labels = _settle(docs, close, written(members.select("id", F.col("id").alias("label")).distinct(), "components"))

    labels = _settle(docs, _rest(docs, rep, members, labels), labels)

    named = classes.join(labels, F.col("rep") == F.col("id"), "left").select(F.col("digest").alias("of"), F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("component"))
    out = all_rows.join(named, (F.col("digest") == F.col("of")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce(F.col("component"), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))


def apply(docs: DataFrame) -> DataFrame:
    """The documents whose id is the least of their component (a repeated row of one id stays once for each row)."""
    key = unused(docs, "near_id")
    stay = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(stay, F.col("doc_id") == F.col(key), "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
