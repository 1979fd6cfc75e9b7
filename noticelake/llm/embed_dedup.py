"""Near-duplicate vectors by NN-descent.

A neighbour graph starts from neighbours in sorted buckets of random hyperplane signs and is refined by local
joins: for every vector, its neighbours are compared with each other, and pairs that beat the worst entry of
either list are kept (neighbours of neighbours). Every comparison that reaches the threshold is also kept as a
link. Where a list is full of links it is saturated; it is then enlarged to its whole component, compared block
against block, and only the counts leave the task.

Vectors with one or two links gain little from neighbours of neighbours, so the start graph alone has to find them: a
label has as many bucketings as leave MISS of the pairs at the threshold unmet, which grows with its size. Recall of
direct links is audited against brute force for a bounded sample of vectors, if these have links enough to tell. Where
links are rare, a second start graph from other hyperplanes is made, and the share of its links that were known before
is the recall. While recall is too low, further rounds follow, each with a start graph of its own, and after the last
one all vectors of a label are compared exactly, block against block. Equal vectors stand as one with a weight; their
numbers come from their digests, so results don't depend on how the table is partitioned.

The graph is built on codes of one byte for each component, a quarter of a vector's size or less. Each code comes with
the length of its error, so a pair's true cosine lies within a known distance of the codes': pairs that are not
decided by it, and these alone, are looked at again in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_spread, load, materialize
from .components import connected_components

#: entries of a neighbour list; neighbours and reverse neighbours that take part in a local join
NEIGHBOURS, SAMPLE = 12, 8
#: following entries of a sorted bucketing that each vector meets, and how many of them it keeps; vectors per bucket
AHEAD, BEST, BUCKET = 12, 3, 24
#: share of the pairs at the threshold that no bucketing of the start graph may bring together; share of the pairs in one
#: bucket that stand within AHEAD of each other (measured: 0.95 and more)
MISS, WITHIN = 0.005, 0.9
#: vectors that recall is audited for, and links of theirs that it takes at least; recall at which rounds stop; most rounds
AUDIT, ENOUGH, RECALL, ROUNDS = 2048, 200, 0.98, 6
BLOCK = 512


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1. A power of two brings each to size first, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def keyed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, lab, vec and, where the vector may link, its digest k0, k1 (null elsewhere)."""
    x = F.col("vec")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("lab"), F.col(vector_col).alias("vec"))
    usable = F.col("id").isNotNull() & F.col("lab").isNotNull() & x.isNotNull() & fine
    return rows.withColumn("k0", F.when(usable, F.xxhash64("lab", "vec"))).withColumn("k1", F.when(usable, F.xxhash64(F.lit(1), "vec", "lab")))


def coded(reps: DataFrame) -> DataFrame:
    """Adds code (the unit vector in bytes), scale and err (length of what the code leaves out)."""

    def run(batches):
        for batch in batches:
            at, dims = batch.schema.get_field_index("vec"), np.array(batch.column("dim").to_pylist())
            code, scale, err = np.empty(len(dims), object), np.ones(len(dims)), np.zeros(len(dims))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = unit(matrix(batch.column(at).take(pa.array(own))))
                step = 127 / np.abs(x).max(1)
                q = np.rint(x * step[:, None])
                scale[own], err[own] = 1 / step, np.sqrt(((x - q / step[:, None]) ** 2).sum(1))
                code[own] = [row.tobytes() for row in q.astype(np.int8)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary()), pa.array(scale), pa.array(err)], names=[*batch.schema.names, "code", "scale", "err"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema)
    return reps.mapInArrow(run, f"{kinds}, code binary, scale double, err double")


def decoded(table) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that the codes stand for (one length), and their errors."""
    raw = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int8).reshape(table.num_rows, -1)
    return raw * table.column("scale").to_numpy()[:, None], table.column("err").to_numpy()


def nearness(sim: np.ndarray, e: np.ndarray, f: np.ndarray, least: float) -> np.ndarray:
    """2 where the true cosine is surely at least `least`, 0 where it surely is not, 1 where the codes do not tell."""
    doubt = e + f + e * f + 1e-9
    return np.where(sim >= least + doubt, 2, np.where(sim < least - doubt, 0, 1)).astype(np.int8)


PAIRS = "u long, v long, sim double, near byte"


def seed_links(reps: DataFrame, least: float, turn: int = 0) -> DataFrame:
    """(u, v, sim, near) of vectors that stand near each other in some sorted bucket; each turn has its own hyperplanes."""
    sizes = reps.groupBy("lab", "dim").agg(F.count(F.lit(1)).alias("n"))
    bits = F.least(F.greatest(F.round(F.log2(F.col("n") / BUCKET)), F.lit(1.0)), F.lit(30.0)).cast("int")
    same_side = 1 - float(np.arccos(least)) / np.pi  # of one hyperplane, for a pair at the threshold
    tables = F.ceil(np.log(MISS) / F.log1p(-WITHIN * F.pow(F.lit(same_side), "bits"))).cast("int")
    sizes = sizes.select("lab", "dim", "n", bits.alias("bits")).withColumn("tables", tables)
    rows = join_spread(reps.select("rep", "lab", "dim", "code", "scale", "err"), sizes, ["lab", "dim"], "n", ["rep"])
    rows = rows.select("rep", "lab", "dim", "code", "scale", "err", "bits", "tables")

    def deal(batches):
        for batch in batches:
            dims, most = np.array(batch.column("dim").to_pylist()), batch.column("tables").to_numpy()
            for dim, t in [(d, t) for d in np.unique(dims).tolist() for t in range(most[dims == d].max())]:
                part = batch.filter(pa.array((dims == dim) & (most > t)))
                x, bits = decoded(part)[0], part.column("bits").to_numpy()
                side = x @ np.random.default_rng((turn, t, dim)).normal(size=(31, dim)).T
                bucket = ((side[:, :30] > 0) & (np.arange(30) < bits[:, None])) @ (1 << np.arange(30))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), part.column("lab"), part.column("dim"), pa.array(bucket.astype(np.int64)), pa.array(side[:, 30]), *(part.column(c) for c in ("rep", "code", "scale", "err"))],
                    names=["t", "lab", "dim", "bucket", "place", "rep", "code", "scale", "err"],
                )

    dealt = rows.mapInArrow(deal, "t int, lab string, dim int, bucket long, place double, rep long, code binary, scale double, err double")
    order = ["t", "lab", "dim", "bucket", "place", "rep"]
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order)

    def meet(batches):
        tail = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([tail, table]) if tail is not None else table
            known = tail.num_rows if tail is not None else 0
            bucket = list(zip(*(table.column(c).to_pylist() for c in ("t", "lab", "dim", "bucket")), strict=True))
            number = np.cumsum([0, *(a != b for a, b in zip(bucket, bucket[1:]))])
            rep, dims, out = table.column("rep").to_numpy(), np.array([b[2] for b in bucket]), []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x, err = decoded(table.take(pa.array(at)))
                sims = np.full((AHEAD, len(at)), -9.0)
                for d in range(1, min(AHEAD + 1, len(at))):
                    a, b = at[:-d], at[d:]
                    ok = (number[a] == number[b]) & (rep[a] != rep[b]) & (b >= known)
                    sims[d - 1, :-d][ok] = (x[:-d][ok] * x[d:][ok]).sum(1)
                best = np.argsort(-sims, axis=0)[:BEST]
                one = np.arange(len(at))
                for d in best:
                    ok = np.flatnonzero(sims[d, one] > -9)
                    other = ok + d[ok] + 1
                    out.append((rep[at[ok]], rep[at[other]], sims[d[ok], ok], nearness(sims[d[ok], ok], err[ok], err[other], least)))
            if out:
                yield links_batch(*map(np.concatenate, zip(*out, strict=True)))
            tail = table.slice(max(0, table.num_rows - AHEAD))

    return dealt.mapInArrow(meet, PAIRS)


def links_batch(u: np.ndarray, v: np.ndarray, sim: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(sim), pa.array(near)], names=["u", "v", "sim", "near"])


def sure_links(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """(u, v) of the pairs that link; those that their codes leave open are compared in double precision."""

    def run(batches):
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            dims = np.array([len(a) for a in batch.column("a")], int)
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                ok[at] = (unit(matrix(batch.column("a").take(at))) * unit(matrix(batch.column("b").take(at)))).sum(1) >= least
            yield batch.filter(pa.array(ok)).select(["u", "v"])

    a, b = reps.select(F.col("rep").alias("u"), F.col("vec").alias("a")), reps.select(F.col("rep").alias("v"), F.col("vec").alias("b"))
    open_pairs = pairs.filter("near = 1").select("u", "v").distinct()
    checked = open_pairs.join(a.hint("merge"), "u").join(b.hint("merge"), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")
    return pairs.filter("near = 2").select("u", "v").unionByName(checked)


def top_lists(pairs: DataFrame) -> DataFrame:
    """(u, v, sim, place): the NEIGHBOURS nearest of every vector among pairs (u < v)."""
    both = pairs.select("u", "v", "sim").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))
    w = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return both.dropDuplicates(["u", "v"]).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= NEIGHBOURS)


def local_joins(lists: DataFrame, reps: DataFrame, turn: int, least: float) -> DataFrame:
    """Compares the neighbours of every vector with each other: pairs that beat the worst entry of either's list."""
    back = lists.select(F.col("v").alias("c"), F.col("u").alias("m"))
    w = Window.partitionBy("c").orderBy(F.xxhash64("m", F.lit(turn)), "m")
    back = back.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= SAMPLE).drop("r")
    ahead = lists.filter(F.col("place") <= SAMPLE).select(F.col("u").alias("c"), F.col("v").alias("m"))
    own = lists.select(F.col("u").alias("c"), F.col("u").alias("m"))
    members = ahead.unionByName(back).unionByName(own).distinct()
    worst = lists.groupBy("u").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("n"))
    worst = worst.select(F.col("u").alias("m"), F.when(F.col("n") < NEIGHBOURS, F.lit(-2.0)).otherwise(F.col("low")).alias("low"))
    known = reps.select(F.col("rep").alias("m"), "code", "scale", "err").join(worst, "m")
    groups = members.join(known, "m").select("c", "m", "low", "code", "scale", "err").repartition("c").sortWithinPartitions("c")

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            c = table.column("c").to_numpy()
            cut = int(np.searchsorted(c, c[-1]))
            if cut:
                yield joined(table.slice(0, cut), c[:cut])
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield joined(held, held.column("c").to_numpy())

    def joined(table, c):
        m, low, err = (table.column(k).to_numpy() for k in ("m", "low", "err"))
        codes, scale = table.column("code").to_pylist(), table.column("scale").to_numpy()
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(c)], strict=True):
            x = np.frombuffer(b"".join(codes[a:b]), np.int8).reshape(b - a, -1) * scale[a:b, None]
            s = x @ x.T
            i, j = np.nonzero(np.triu((s > low[a:b]) | (s > low[a:b, None]), 1))
            out.append((m[a:b][i], m[a:b][j], s[i, j], nearness(s[i, j], err[a:b][i], err[a:b][j], least)))
        return links_batch(*map(np.concatenate, zip(*out, strict=True)))

    return groups.mapInArrow(compare, PAIRS).dropDuplicates(["u", "v"])


def audit_truth(reps: DataFrame, least: float) -> DataFrame:
    """All links of at most AUDIT vectors, the first by hash, by brute force: (q, v)."""
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(AUDIT).select("rep", "lab", "dim", "vec").collect()
    groups: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for lab, dim in {(r["lab"], r["dim"]) for r in sample}:
        own = [r for r in sample if (r["lab"], r["dim"]) == (lab, dim)]
        groups[lab, dim] = np.array([r["rep"] for r in own]), unit(np.array([r["vec"] for r in own], np.float64))
    held = reps.sparkSession.sparkContext.broadcast(groups)  # at most AUDIT vectors

    def run(batches):
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            rep, qs, vs = batch.column(0).to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for key in set(keys) & held.value.keys():
                at = np.array([i for i, k in enumerate(keys) if k == key])
                q, x = held.value[key]
                i, j = np.nonzero(unit(matrix(batch.column(3).take(pa.array(at)))) @ x.T >= least)
                ok = rep[at][i] != q[j]
                qs.append(q[j][ok])
                vs.append(rep[at][i][ok])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qs)), pa.array(np.concatenate(vs))], names=["q", "v"])

    return materialize(reps.select("rep", "lab", "dim", "vec").mapInArrow(run, "q long, v long"), "audit")


def saturated(lists: DataFrame, comps: DataFrame, least: float) -> DataFrame:
    """(comp, size) of the components with a list that is full of links; they are to be enlarged."""
    full = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low")).filter((F.col("n") >= NEIGHBOURS) & (F.col("low") >= least))
    flag = comps.join(full.select(F.col("u").alias("rep"), F.lit(1).alias("full")), "rep", "left")
    return flag.groupBy("comp").agg(F.count(F.lit(1)).alias("size"), F.max("full").alias("full")).filter("full = 1").select("comp", "size")


def audit(truth: DataFrame, links: DataFrame, within: DataFrame) -> tuple[int, int]:
    """The sample's true links, and those of them that count: found directly, or inside one component that is to be
    enlarged (within: rep and comp of these)."""
    a, b = within.select(F.col("rep").alias("q"), F.col("comp").alias("a")), within.select(F.col("rep").alias("v"), F.col("comp").alias("b"))
    direct = links.select(F.col("u").alias("low"), F.col("v").alias("high"), F.lit(True).alias("direct"))
    ends = truth.withColumns({"low": F.least("q", "v"), "high": F.greatest("q", "v")})
    found = F.coalesce("direct", F.lit(False)) | F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    row = ends.join(direct, ["low", "high"], "left").join(a, "q", "left").join(b, "v", "left").agg(F.count(F.lit(1)), F.count_if(found)).first()
    return row[0], row[1]


def found_again(known: DataFrame, fresh: DataFrame) -> tuple[int, int]:
    """Links of a start graph of its own, and those of them that were known before: (u, v) of both, once each."""
    row = fresh.join(known.withColumn("old", F.lit(True)), ["u", "v"], "left").agg(F.count(F.lit(1)), F.count("old")).first()
    return row[0], row[1]


def dealt_blocks(members: DataFrame) -> DataFrame:
    """members: (comp, size, rep, weight, vec), each dealt to all pairs (i, j) of blocks of its comp that hold its own."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "weight", "vec"
    )


def compared(key, table, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of block i, rows of block j, and which of them link."""
    x, rep, block = unit(matrix(table.column("vec"))), table.column("rep").to_numpy(), table.column("block").to_numpy()
    a, b = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
    return a, b, (x[a] @ x[b].T >= least) & (rep[a][:, None] != rep[b])


def dense_counts(members: DataFrame, least: float) -> DataFrame:
    """members: (comp, size, rep, weight, vec) -> (rep, n): weights of the others of its component that each links with."""

    def count(key, table):
        rep, weight = table.column("rep").to_numpy(), table.column("weight").to_numpy()
        a, b, near = compared(key, table, least)
        out = [(rep[a], near @ weight[b])] + ([(rep[b], near.T @ weight[a])] if key[1] != key[2] else [])
        return pa.table({"rep": np.concatenate([r for r, _ in out]), "n": np.concatenate([n for _, n in out]).astype(np.int64)})

    return dealt_blocks(members).groupBy("comp", "i", "j").applyInArrow(count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))


def dense_stars(members: DataFrame, least: float) -> DataFrame:
    """members as above -> (u, v): for each pair of blocks a star on every group that its links connect."""

    def stars(key, table):
        rep = table.column("rep").to_numpy()
        a, b, near = compared(key, table, least)
        us, vs, left = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.ones(len(b), bool)
        todo = near.any(1)
        while todo.any():
            root = int(todo.argmax())
            rows = np.array([root])
            while len(rows):
                todo[rows] = False
                cols = near[rows].any(0) & left
                left &= ~cols
                ends = np.concatenate([rep[a[rows]], rep[b[cols]]])
                us.append(np.full(len(ends), rep[a[root]]))
                vs.append(ends)
                rows = np.flatnonzero(near[:, cols].any(1) & todo)
        return pa.table({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return dealt_blocks(members).groupBy("comp", "i", "j").applyInArrow(stars, "u long, v long")


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links vectors of equal label whose cosine, in double precision, is at least `least`.

    Returns one row per input row: id_col, n_links (other vectors linked directly), component_id (smallest id
    reachable by links, itself included), kept. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows with a null label or id, link with nothing. Vectors of different lengths do not link.
    Rows that repeat an id and its vector are one vector each; one id on different vectors has a row for each. An empty
    table gives no rows; extra columns are ignored. Very long vectors are taken whole, and vectors of any finite size
    are compared. Links below the threshold never appear; above it some may be missed: at most 1 - RECALL of those that
    audit() or, where it sees fewer than ENOUGH, found_again() looks at.
    """
    rows = keyed(vectors, id_col, vector_col, label_col)
    classes = rows.filter("k0 is not null").groupBy("k0", "k1").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("weight"), F.first("lab").alias("lab"), F.first("vec").alias("vec"))
    # the first half of the digest, counted on where classes share it
    rep = F.col("k0") + F.row_number().over(Window.partitionBy("k0").orderBy("k1")) - 1
    reps = classes.select(rep.alias("rep"), "k0", "k1", "low", "weight", "lab", F.size("vec").alias("dim"), "vec")
    reps = materialize(coded(reps), "reps")

    pairs = materialize(seed_links(reps, least).dropDuplicates(["u", "v"]), "seeds")
    links = sure_links(pairs, reps, least)
    truth, lists = audit_truth(reps, least), materialize(top_lists(pairs), "lists")
    for turn in range(ROUNDS):
        new = materialize(local_joins(lists, reps, turn, least), "joined")
        old = lists.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sim")
        last, lists = lists, materialize(top_lists(new.select("u", "v", "sim").unionByName(old)), "lists")
        discard(last)
        seen = known = 0
        if turn:
            pairs = materialize(seed_links(reps, least, turn).dropDuplicates(["u", "v"]), "seeds")
            fresh = materialize(sure_links(pairs, reps, least).distinct(), "fresh")
            seen, known = found_again(links, fresh)
            lists = materialize(top_lists(lists.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sim").unionByName(pairs.select("u", "v", "sim"))), "lists")
            links = links.unionByName(fresh)
        links = materialize(links.unionByName(sure_links(new, reps, least)).distinct(), "links")
        comps = materialize(connected_components(links).select(F.col("id").alias("rep"), F.col("component_id").alias("comp")), "comps")
        dense = materialize(saturated(lists, comps, least), "dense")
        within = materialize(join_spread(comps, dense, "comp", "size", ["rep"]).select("rep", "comp", "size"), "within")
        true, found = audit(truth, links, within)
        # few links in the sample tell little: then those of a second start graph, which may be none, have to be known
        if found >= RECALL * true and (true >= ENOUGH or (turn and known >= RECALL * seen)):
            members = within.join(reps, "rep").select("comp", "size", "rep", "weight", "vec")
            weights = reps.select(F.col("rep").alias("v"), "weight")
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            sparse = both.join(weights, "v").groupBy(F.col("u").alias("rep")).agg(F.sum("weight").alias("few"))
            counts = sparse.join(dense_counts(members, least), "rep", "left").select("rep", F.coalesce("n", "few").alias("n"))
            break
    else:  # the rounds did not reach RECALL: every vector with every other of its label and length
        sizes = reps.groupBy("lab", "dim").agg(F.count(F.lit(1)).alias("size"))
        members = join_spread(reps, materialize(sizes, "sizes"), ["lab", "dim"], "size", ["rep"])
        members = members.select(F.concat_ws(":", F.col("dim").cast("string"), "lab").alias("comp"), "size", "rep", "weight", "vec")
        comps = materialize(connected_components(dense_stars(members, least)).select(F.col("id").alias("rep"), F.col("component_id").alias("comp")), "comps")
        counts = dense_counts(members, least)

    of_rep = reps.select("rep", "k0", "k1", "low", "weight").join(comps, "rep", "left").join(counts, "rep", "left")
    lowest = of_rep.filter("comp is not null").groupBy("comp").agg(F.min("low").alias("lowest"))
    of_class = of_rep.join(lowest, "comp", "left").select("k0", "k1", "weight", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("lowest", "low").alias("comp"))
    of_class = materialize(of_class, "classes")
    linked = join_spread(rows.filter("k0 is not null").select("id", "k0", "k1"), of_class, ["k0", "k1"], "weight", ["id"]).select("id", "n_links", "comp")
    out = linked.unionByName(rows.filter("k0 is null").select("id", F.lit(0).alias("n_links"), F.col("id").alias("comp")))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("comp").alias("component_id"), F.col("id").eqNullSafe(F.col("comp")).alias("kept"))


def op8(spark, sf_dir):
    return near_vectors(load(spark, sf_dir, "embeddings"))
