"""Hard-negative mining: exact nearest rows from candidate lists that the anchors of a cluster share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import written

# Candidates of a block, candidates multiplied at a time, members that walk a list together.
BLOCK_ROWS, STRIDE, MEMBERS = 16384, 512, 1024
# Directions that rows are dealt by: at most this many, fitted on at most so many rows.
PIVOTS, SAMPLE_ROWS = 1024, 4096
# Products stay below 2**46, so that a product and a place in a block of at most 2**16 rows share 64 bits.
PLACE_BITS, PRODUCT_BITS = 16, 46
NONE = np.iinfo(np.int64).min
# Bounds are widened by this much against rounding; products are whole numbers.
SLACK = 1e-6
ROUND_SCHEMA = "row bigint, anchor_id bigint, slot int, score bigint, found bigint"


def quantized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, whole-number components as 8-byte floats, norm) of the rows that take part."""
    for batch in batches:
        vectors = batch.column(2)
        sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        fine = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes])
        whole = np.floor(256 * np.where(np.isfinite(flat), flat, 0))
        at = np.flatnonzero(fine)
        parts = [whole[ends[i] - sizes[i] : ends[i]] for i in at]
        columns = [
            batch.column(0).take(pa.array(at)),
            batch.column(1).take(pa.array(at)),
            pa.array([p.astype("<f8").tobytes() for p in parts], pa.binary()),
            pa.array([float(np.sqrt(p @ p)) for p in parts], pa.float64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "vector", "norm"])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row per vector; shorter vectors end in zeros."""
    out = np.zeros((len(column), width))
    for i, raw in enumerate(column.to_pylist()):
        one = np.frombuffer(raw, dtype="<f8")
        out[i, : len(one)] = one
    return out


def units(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1, 1))


def fit_pivots(sample: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Unit vectors that stand for the directions in the sample (spherical k-means)."""
    unit = units(sample)
    rng = np.random.default_rng(seed)
    centres = unit[rng.permutation(len(unit))[:count]]
    for _ in range(8):
        nearest = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        moved = units(sums)
        centres = np.where(moved.any(axis=1, keepdims=True), moved, centres)
    return centres


class Plan:
    """What every task knows: pivots, and per pivot its widest angle, longest vector, blocks and members' widest angle."""

    def __init__(self, pivots: np.ndarray, width: int):
        self.pivots, self.width = pivots, width
        n = len(pivots)
        self.spread, self.longest = np.zeros(n), np.zeros(n)
        self.pieces, self.first = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.reach = np.zeros(n)

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """No product of a vector and a row of a pivot is above this."""
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        apart = np.maximum(angles(units(vectors), self.pivots) - self.spread - SLACK, 0)
        return norms * self.longest * np.maximum(np.cos(apart), 0) * (1 + SLACK) + 0.5


class Block:
    """Candidates in order of their ids, and the list of the cluster at hand."""

    def __init__(self, plan: Plan, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.plan, self.ids, self.labels, self.vectors = plan, ids[order], labels[order], vectors[order]
        self.norms, self.unit = np.linalg.norm(self.vectors, axis=1), units(self.vectors)
        self.cluster = -1

    def list_of(self, cluster: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates by falling bound on their product with a unit vector of the cluster; sorted once for all members."""
        if cluster != self.cluster:
            apart = angles(self.unit, self.plan.pivots[cluster : cluster + 1])[:, 0] - self.plan.reach[cluster] - SLACK
            bound = self.norms * np.cos(np.maximum(apart, 0))
            bound += np.abs(bound) * SLACK
            self.order = np.argsort(-bound, kind="stable")
            self.bound, self.cluster = bound[self.order], cluster
        return self.order, self.bound

    def walk(self, cluster: int, members: dict[str, np.ndarray], slots: int, keep: int) -> np.ndarray:
        """The best ``keep`` keys per member and slot, found along the cluster's list.

        A slot takes rows of the wanted kind of label with a product from its floor to its cap. A member
        leaves the list when no row further on can reach the floor or the worst row kept, in every slot.
        """
        order, bound = self.list_of(cluster)
        n = len(members["id"])
        best = np.full((n, slots, keep), NONE)
        norms = np.linalg.norm(members["vector"], axis=1)
        active = np.arange(n)
        for at in range(0, len(order), STRIDE):
            worst = np.where(best[active, :, -1] == NONE, NONE, best[active, :, -1] >> PLACE_BITS)
            need = np.maximum(members["floor"][active], worst).min(axis=1)
            active = active[norms[active] * bound[at] + 0.5 >= need]
            if not len(active):
                break
            some = order[at : at + STRIDE]
            score = (members["vector"][active] @ self.vectors[some].T).astype(np.int64)
            alike = members["label"][active][:, None] == self.labels[some]
            fits = (alike == members["same"][active][:, None]) & (members["id"][active][:, None] != self.ids[some])
            key = (score << PLACE_BITS) | ((1 << PLACE_BITS) - 1 - some)
            for slot in range(slots):
                low, high = members["floor"][active, slot][:, None], members["cap"][active, slot][:, None]
                taken = np.where(fits & (score >= low) & (score <= high), key, NONE)
                both = np.concatenate([best[active, slot], taken], axis=1)
                cut = np.partition(both, both.shape[1] - keep, axis=1)[:, -keep:]
                best[active, slot] = -np.sort(-cut, axis=1) if keep > 1 else cut
        return best


def walker(plan: Plan, slots: int, keep: int, same: bool):
    """Turns a sorted stream of blocks (candidates, then anchors by cluster) into the rows found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        now, parts, blocks = None, [], []

        def code(column: pa.Array) -> np.ndarray:
            return np.array([codes.setdefault(v, len(codes)) for v in column.to_pylist()], dtype=np.int64)

        def loaded() -> list[Block]:
            rows = pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []
            out, limit = [], 1 << PLACE_BITS
            for batch in rows:
                for at in range(0, batch.num_rows, limit):
                    b = batch.slice(at, limit)
                    ids = b.column("id").to_numpy(zero_copy_only=False)
                    out.append(Block(plan, ids, code(b.column("label")), matrix(b.column("vector"), plan.width)))
            return out

        for batch in batches:
            block, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cluster = batch.column(2).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0) | (np.diff(cluster) != 0)) + 1
            for start, stop in zip([0, *change], [*change, batch.num_rows], strict=True):
                if not batch.num_rows:
                    continue
                if block[start] != now:
                    now, parts, blocks = block[start], [], []
                if kind[start] == 0:
                    parts.append(batch.slice(start, stop - start))
                    continue
                if parts:
                    blocks, parts = loaded(), []
                for at in range(start, stop, MEMBERS):
                    some = batch.slice(at, min(MEMBERS, stop - at))
                    members = {
                        "id": some.column("id").to_numpy(zero_copy_only=False),
                        "label": code(some.column("label")),
                        "vector": matrix(some.column("vector"), plan.width),
                        "floor": np.array(some.column("floors").to_pylist(), dtype=np.int64).reshape(-1, slots),
                        "cap": np.array(some.column("caps").to_pylist(), dtype=np.int64).reshape(-1, slots),
                        "same": np.full(some.num_rows, same),
                    }
                    for each in blocks:
                        best = each.walk(int(cluster[start]), members, slots, keep)
                        who, slot, place = np.nonzero(best != NONE)
                        key = best[who, slot, place]
                        found = each.ids[(1 << PLACE_BITS) - 1 - (key & ((1 << PLACE_BITS) - 1))]
                        columns = [
                            some.column("row").take(pa.array(who)),
                            some.column("id").take(pa.array(who)),
                            pa.array(slot.astype(np.int32)),
                            pa.array(key >> PLACE_BITS),
                            pa.array(found, pa.int64()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=["row", "anchor_id", "slot", "score", "found"])

    return run


def visits(plan: Plan, seed: bool):
    """Sends each anchor to the blocks of its own pivot (``seed``), or of all others that may hold better rows."""
    schema = pa.schema(
        [("block", pa.int64()), ("kind", pa.int32()), ("cluster", pa.int32()), ("row", pa.int64()), ("id", pa.int64()),
         ("label", pa.string()), ("vector", pa.binary()), ("floors", pa.list_(pa.int64())), ("caps", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                own = batch.column("pivot").to_numpy(zero_copy_only=False)
                goes = np.zeros((batch.num_rows, len(plan.pivots)), dtype=bool)
                goes[np.arange(len(own)), own] = True
                if not seed:
                    need = np.array([min(f) for f in batch.column("floors").to_pylist()], dtype=np.float64)
                    goes = ~goes & (plan.bounds(matrix(batch.column("vector"), plan.width)) >= need[:, None])
                for at in range(0, len(own), 16):
                    who, pivot = np.nonzero(goes[at : at + 16])
                    times = plan.pieces[pivot]
                    who = np.repeat(who + at, times)
                    block = np.repeat(plan.first[pivot], times) + np.concatenate([np.arange(t) for t in times] or [[]]).astype(np.int64)
                    rest = [batch.column(c).take(pa.array(who)) for c in ("row", "id", "label", "vector", "floors", "caps")]
                    columns = [pa.array(block), pa.array(np.ones(len(who), np.int32)), pa.array(own[who].astype(np.int32)), *rest]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


VISIT_SCHEMA = (
    "block bigint, kind int, cluster int, row bigint, id bigint, label string, vector binary, "
    "floors array<bigint>, caps array<bigint>"
)


def best(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "found")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def search(plan: Plan, blocks: DataFrame, anchors: DataFrame, slots: int, keep: int, same: bool) -> DataFrame:
    """The best ``keep`` rows per anchor and slot, between its ``floors`` and ``caps`` (bigint arrays of ``slots``).

    Two visits: first the blocks of the anchor's own pivot; the products found there raise the floors, and
    only pivots whose bound reaches a floor are visited after that.
    """

    def visit(asking: DataFrame, seed: bool) -> DataFrame:
        sent = asking.mapInArrow(visits(plan, seed), VISIT_SCHEMA)
        both = blocks.unionByName(sent, allowMissingColumns=True).repartition("block")
        stream = both.sortWithinPartitions("block", "kind", "cluster").select(*VISIT_SCHEMA_NAMES)
        return stream.mapInArrow(walker(plan, slots, keep, same), ROUND_SCHEMA)

    near = written(best(visit(anchors, True), keep), "near")
    # The worst of ``keep`` rows is a floor for all others; equal products may still win by their id.
    full = near.where(F.col("place") == keep).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("worst"))
    raised = F.transform("floors", lambda f, i: F.greatest(f, F.coalesce(F.element_at("worst", i.cast("int")), f)))
    later = anchors.join(full, "row", "left").withColumn("floors", raised).drop("worst")
    far = visit(later, False)
    return written(best(near.drop("place").union(far), keep), "best")


VISIT_SCHEMA_NAMES = [part.split()[0] for part in VISIT_SCHEMA.split(", ")]


def hard_negatives(
    rows: DataFrame,
    asks: Column,
    positives: int = 5,
    negatives: int = 3,
    percent: tuple[int, int] = (50, 95),
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    seed: int = 7,
) -> DataFrame:
    """For each anchor (``asks`` on the column ``id``) and each of its positives the hardest allowed negatives.

    Components count as floor(256 x). An anchor's positives are its ``positives`` best other rows of the same
    label, by whole-number inner product, ties to the smaller id; its negatives for one of them are the best
    ``negatives`` rows of other labels whose product lies between the two percentages of the positive's.
    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Rows are dealt to pivot directions (at most 1,024, fitted on at most 4,096 rows, a documented bound)
    and from there to blocks by a hash, so a direction with a third of all rows is many blocks. The
    anchors of a pivot are a cluster: in each block they visit, candidates are sorted once by an upper bound
    on their product with any member, from norms and angles to the cluster's centre, and every member walks that
    list until no later candidate can matter. Blocks whose pivot's bound shows the same are not visited.

    Of rows with equal labels and vectors only the ``positives`` + 1 smallest ids can be in a result, so copies
    cost nothing. Rows with a null id, label or vector, or a null or non-finite component take no part. A row is
    no candidate of an anchor with its id; repeated rows are rows. Shorter vectors count as ending in
    zeros. Vectors with a norm of 2**23 (x of 2**15) or more are an error, as products must be whole numbers.
    """
    spark = rows.sparkSession
    source = rows.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    ).where("id IS NOT NULL AND label IS NOT NULL")
    took = source.mapInArrow(quantized, "id bigint, label string, vector binary, norm double")
    table = written(took.withColumn("row", F.monotonically_increasing_id()), "rows")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    n, longest, width = table.agg(F.count("*"), F.max("norm"), F.max(F.octet_length("vector"))).first()
    if not n or not width:
        return spark.createDataFrame([], schema)
    if longest * longest >= 1 << PRODUCT_BITS:
        raise ValueError(f"a vector has the norm {longest / 256:.0f}, too long for whole-number products")
    sample = table.orderBy(F.xxhash64("id", "label"), "row").limit(SAMPLE_ROWS).select("vector").toArrow().column(0)
    width //= 8
    pivots = fit_pivots(matrix(sample, width), min(PIVOTS, max(1, round(n**0.5 / 8))), seed)
    plan = Plan(pivots, width)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                cosine = units(matrix(part.column("vector"), width)) @ pivots.T
                nearest = cosine.argmax(axis=1).astype(np.int32)
                own = cosine[np.arange(len(nearest)), nearest]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(nearest), pa.array(own)], names=[*part.schema.names, "pivot", "cosine"])

    # The least ids per label and vector, ranked in salted parts before they meet.
    alike = ["label", F.xxhash64("vector"), "vector"]
    copies = Window.partitionBy(*alike, F.pmod(F.xxhash64("row"), F.lit(64))).orderBy("id", "row")
    whole = Window.partitionBy(*alike).orderBy("id", "row")
    few = table.withColumn("r", F.row_number().over(copies)).where(F.col("r") <= positives + 1)
    few = few.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= positives + 1).drop("r")
    placed_schema = "id bigint, label string, vector binary, norm double, row bigint, pivot int, cosine double"
    placed = written(few.mapInArrow(place, placed_schema), "placed")
    anchors = written(table.where(asks).mapInArrow(place, placed_schema), "anchors")
    # At most one row per pivot. Vectors of zeros have no angle; their products are zero, which no bound is below.
    turned = F.when(F.col("norm") > 0, F.col("cosine"))
    summary = placed.groupBy("pivot").agg(F.count("*").alias("n"), F.min(turned).alias("cosine"), F.max("norm").alias("longest")).collect()
    for r in sorted(summary, key=lambda r: r["pivot"]):
        p = r["pivot"]
        plan.spread[p] = 0 if r["cosine"] is None else np.arccos(np.clip(r["cosine"], -1, 1))
        plan.longest[p], plan.pieces[p] = r["longest"], -(-r["n"] // block_rows)
    plan.first = np.concatenate([[0], np.cumsum(plan.pieces)[:-1]])
    for r in anchors.groupBy("pivot").agg(F.min(turned).alias("cosine")).collect():
        plan.reach[r["pivot"]] = 0 if r["cosine"] is None else np.arccos(np.clip(r["cosine"], -1, 1))

    first, pieces = (F.array(*(F.lit(int(v)) for v in values)) for values in (plan.first, np.maximum(plan.pieces, 1)))
    piece = F.pmod(F.xxhash64("row"), F.get(pieces, F.col("pivot")))
    blocks = placed.select(
        (F.get(first, F.col("pivot")) + piece).cast("bigint").alias("block"), F.lit(0).alias("kind"), F.lit(0).alias("cluster"),
        "row", "id", "label", "vector",
    )
    low, high = -(1 << 62), 1 << 62
    asking = anchors.select("row", "id", "label", "vector", "pivot", F.array(F.lit(low)).alias("floors"), F.array(F.lit(high)).alias("caps"))
    liked = search(plan, blocks, asking, 1, positives, True)
    # Floors and caps per positive; a positive without room between them gets a floor that nothing reaches.
    score = F.col("liked.score")
    ranked = liked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "score", "found"))).alias("liked"))

    def limits(percentage: int, up: bool) -> Column:
        each = lambda s: F.ceil(s * percentage / 100) if up else F.floor(s * percentage / 100)
        return F.transform(score, lambda s: each(s.cast("decimal(20,0)")).cast("bigint"))

    pad = lambda values, filler: F.slice(F.concat(values, F.array_repeat(F.lit(filler), positives)), 1, positives)
    floors, caps = pad(limits(percent[0], True), high), pad(limits(percent[1], False), low)
    room = F.zip_with(floors, caps, lambda f, c: F.when(f > c, F.lit(high)).otherwise(f))
    asking = anchors.join(ranked, "row").select("row", "id", "label", "vector", "pivot", room.alias("floors"), caps.alias("caps"))
    asking = written(asking.where(F.array_min("floors") < high), "asking")
    hated = search(plan, blocks, asking, positives, negatives, False)
    pairs = liked.select("row", (F.col("place") - 1).cast("int").alias("slot"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    return hated.join(pairs, ["row", "slot"]).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
