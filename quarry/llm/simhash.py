"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance 3 have no common neighbour at distance 1, so the radius is made even first: the 64 bits fall
into three blocks, and leaving out the block with the most differing bits leaves a distance of at most 2 on the other two.
There half the radius is 1: each fingerprint emits, for each pair of blocks, itself and all variants with one bit flipped
(131 keys), the variants are shuffled, and fingerprints that meet are deduplicated and verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.bloom import Bloom
from quarry.llm.common import LOWER, WORDS, Batches, column_bytes, batches_of, limit_batches, stored
from quarry.llm.components import connected_components
from quarry.llm.likeness import bands, merge_similar, shingles, signature, text_key

RADIUS = 3
SEED = 42
#: Fingerprints that meet in one key are compared with each other up to this many; larger meetings take the exact linear way.
MEETING = 1024
_BLOCKS = ((0, 21), (21, 42), (42, 64))


def _mask(lo: int, hi: int) -> int:
    return (1 << hi) - (1 << lo)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash(text: bytes, width: int = 3) -> int:
    """Fingerprint of a text: majority bits of the XXH64 of its word shingles; no words: zero."""
    words = WORDS.findall(text.translate(LOWER))
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[i:j], SEED) for i, j in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(words) - width + 1
    )
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, similar: bool = False) -> DataFrame:
    """`doc_id, fp` (long, the 64 bits) for every row; with `similar` also what links texts by likeness: `d` (the text's key), `n`, `h` and `bands`. A null text is empty."""
    limit_batches(docs.sparkSession)
    names = ["doc_id", "fp", "d", "n", "h", "bands"]

    def run(batches: Batches) -> Batches:
        for b in batches:
            texts = column_bytes(b.column(1))
            out = [b.column(0).cast(pa.int64()), pa.array([_signed(simhash(t, width)) for t in texts], pa.int64())]
            if similar:
                sets = [shingles(t) for t in texts]
                keys = pa.array([bands(s).tolist() for s in sets], pa.list_(pa.int64()))
                out += [b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), keys]
            yield pa.record_batch(out, names[: len(out)])

    key = [text_key(F.col(text_col)).alias("d")] if similar else []
    more = ", d long, n long, h binary, bands array<long>" if similar else ""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), *key).mapInArrow(run, "doc_id long, fp long" + more)


def _ball() -> list[tuple[int, int]]:
    """(mask, flip) of each key; flip also marks the pair of blocks in the bits that the mask leaves out."""
    out = []
    for left_out, (lo, hi) in enumerate(_BLOCKS):
        mask = _mask(0, 64) & ~_mask(lo, hi)
        tag = left_out << lo
        out += [(mask, tag)] + [(mask, tag ^ (1 << bit)) for bit in range(64) if not lo <= bit < hi]
    return out


def _variants(fps: DataFrame) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.lit(_signed(x)).alias("flip")) for m, x in _ball()])
    return fps.select("fp", F.explode(F.transform(keys, lambda k: F.col("fp").bitwiseAND(k["mask"]).bitwiseXOR(k["flip"]))).alias("key"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it would count the bits of the absolute value


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links within one meeting, as few as a forest has."""
    near = _distances(members[:, None], members[None, :]) <= radius
    out, left = [], np.ones(len(members), bool)
    for root in range(len(members)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(near[at] & left)
            left[new] = False
            out += [(int(members[at]), int(members[x])) for x in new]
            front += new.tolist()
    return out


def _runs(batches: Batches) -> Batches:
    """Whole keys at a time would need unbounded memory; instead cut the sorted stream where the key changes, where it does."""
    rest: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([rest, b] if rest is not None else [b]).combine_chunks()
        b = t.to_batches()[0]
        keys = b.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield b.slice(0, cut)
        rest = b.slice(cut)
        if rest.num_rows > 4 * MEETING:  # a hot key: what is certain to exceed MEETING goes on in pieces
            yield rest
            rest = None
    if rest is not None and rest.num_rows:
        yield rest


def _meet(radius: int, meeting: int) -> Callable[[Batches], Batches]:
    schema = pa.schema([("hot", pa.bool_()), ("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Batches) -> Batches:
        hot_key = None
        for b in _runs(batches):
            keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            u, v, hot = [], [], []
            pairs = starts[sizes == 2]
            near = pairs[_distances(fps[pairs], fps[pairs + 1]) <= radius]
            u.append(fps[near])
            v.append(fps[near + 1])
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if n > meeting or keys[s] == hot_key:
                    hot_key = keys[s]
                    hot.append(fps[s : s + n])
                elif found := _forest(fps[s : s + n], radius):
                    u.append(np.array([x for x, _ in found], np.int64))
                    v.append(np.array([x for _, x in found], np.int64))
            if hot_key is not None and keys[0] == hot_key and sizes[0] <= 2:  # the tail of a hot key that was cut into pieces
                hot.append(fps[: sizes[0]])
            edges, heat = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1), np.unique(np.concatenate([*hot, fps[:0]]))
            if edges.shape[1] or len(heat):
                yield pa.record_batch(
                    [
                        pa.array(np.concatenate([np.zeros(edges.shape[1], bool), np.ones(len(heat), bool)])),
                        pa.array(np.concatenate([edges[0], heat])),
                        pa.array(np.concatenate([edges[1], heat])),
                    ],
                    schema=schema,
                )

    return run


def _centres(batches: Batches) -> Batches:
    """Of rows sorted by (key, reach, fp): link all fingerprints of a key to its first, if that is within distance 1 of the key."""
    key = centre = None
    for b in batches:
        keys, reach, fps = (b.column(i).to_numpy() for i in range(3))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        centres = np.where(reach[starts] <= 1, fps[starts], 0)
        valid = reach[starts] <= 1
        if len(keys) and key is not None and keys[0] == key:
            centres[0], valid[0] = (centre, True) if centre is not None else (0, False)
        sizes = np.diff(np.append(starts, len(keys)))
        if len(keys):
            key, centre = keys[-1], int(centres[-1]) if valid[-1] else None
        of, ok = np.repeat(centres, sizes), np.repeat(valid, sizes)
        ok &= of != fps
        edges = np.unique(np.stack([of[ok], fps[ok]]), axis=1)
        yield pa.record_batch([pa.array(edges[0]), pa.array(edges[1])], ["u", "v"])


def _hot_links(hot: DataFrame) -> DataFrame:
    """Links among fingerprints of crowded keys, exact and without comparing pairs.

    On all 64 bits, each emits its ball of radius 1 and the variants with two flipped bits of one half. Of three differing
    bits two lie in one half, so any two fingerprints within distance 3 share a key that one of them reaches with at most
    one flip; and all that share a key with such a one are within distance 3 of it. So linking to it loses and invents none.
    """
    flips = [0, *[1 << i for i in range(64)], *[1 << i | 1 << j for i in range(64) for j in range(i + 1, 64) if i // 32 == j // 32]]
    keys = F.array(*[F.lit(_signed(x)) for x in flips])
    rows = hot.select("fp", F.explode(keys).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), F.bit_count("flip").alias("reach"), "fp")
    n = int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key").sortWithinPartitions("key", "reach", "fp").mapInArrow(_centres, "u long, v long").distinct()


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, meeting: int = MEETING) -> DataFrame:
    """`u, v`: links that connect all distinct values of `fps.fp` (long) at `radius` (3) or fewer differing bits.

    The links are a spanning subset: their connected components are those of all links, without all pairs of a group.
    """
    if radius != RADIUS:
        raise ValueError("the blocks are laid out for a radius of 3")
    spark = fps.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = fps.select("fp").distinct().repartition(n)  # few bytes, but each row becomes 131: one task each for them all would not do
    met = _variants(distinct).select("key", "fp").repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_meet(radius, meeting), "hot boolean, u long, v long")
    with batches_of(spark, 20_000):  # narrow rows
        met = stored(met, "meetings")
    edges = met.where("not hot").select("u", "v")
    hot = met.where("hot").select(F.col("u").alias("fp")).distinct()
    return edges.union(_hot_links(hot)) if hot.take(1) else edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", meeting: int = MEETING) -> DataFrame:
    """`doc_id, fingerprint, component_id` for every row of `docs`.

    `fingerprint` has 16 lowercase hex digits; `component_id` is the smallest doc_id reachable over links, the row's own
    included. Rows with equal ids or texts are each returned; a null id is never a component's id unless no member has
    another. Null and empty texts have fingerprint zero and link like any other. Other columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    grouped = connected_components(link_fingerprints(distinct))
    of = distinct.join(grouped, distinct["fp"] == grouped["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    labelled = of.join(least, "component").select("fp", "component_id")
    return prints.join(labelled, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id, component_id` for every row of `docs`, as `near_duplicates`, but linked also by a similarity of 0.8 on five-word shingles."""
    prints = stored(fingerprints(docs, id_col, text_col, similar=True), "fingerprints")
    texts = prints.groupBy("d").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "h", "bands")])
    grouped = connected_components(link_fingerprints(prints.select("fp")))
    known = texts.join(grouped, texts["fp"] == grouped["node"], "left").select("d", "first_id", "n", "h", "bands", F.coalesce("component", "fp").alias("component"))
    texts = known = stored(known, "linked")
    merged = merge_similar(docs, known, text_col)
    labelled = texts.select("d", "first_id").join(merged, "d")
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return prints.join(labelled.join(least, "component").select("d", "component_id"), "d").select("doc_id", "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: bool = False) -> DataFrame:
    """The rows of `docs`, all columns, whose id is the component_id of its near-duplicates: one document of each group.

    With `similar`, near-duplicates are also texts with a similarity of 0.8 or more on five-word shingles.

    Rows without an id can stand for no group and stay only if no member of their group has one. All rows stay that have an
    id which stands for a group, so rows that repeat an id stay or go together. The decision is joined by id; Spark
    broadcasts it only below its own threshold.
    """
    judged = similar_documents(docs, id_col, text_col) if similar else near_duplicates(docs, id_col, text_col)
    stands = F.col("doc_id").eqNullSafe(F.col("component_id"))
    decided = judged.groupBy(F.col("doc_id").alias("__id")).agg(F.bool_or(stands).alias("__kept"), F.bool_or(~stands).alias("__gone"))
    decided = stored(decided, "representatives")
    names = docs.columns
    rows = docs.select(F.col(id_col).cast("long").alias("__of"), F.struct(*[F.col(c) for c in names]).alias("__row"))
    kept = decided.where("__kept").select("__id")
    gone = Bloom(decided.where("__gone").select("__id"), "__id")
    joined = gone.maybe(rows, "__of").join(kept, F.col("__of").eqNullSafe(F.col("__id")), "left_semi").union(gone.never(rows, "__of"))
    return joined.select(*[F.col(f"__row.`{c}`").alias(c) for c in names])
