"""MinHash near-deduplication with a multi-index Hamming join.

Documents become sets of word shingles; equal sets become one class. A class's signature has POSITIONS b-bit
minima. Signatures at a distance (positions that differ) of at most DISTANCE are all brought together: split
into CHUNKS parts, two such signatures differ in at most DISTANCE // CHUNKS positions of some part (pigeonhole),
so every part is indexed under each way to leave out that many positions.

Buckets of one key are not paired out. Every class joins the group of each of its buckets' head, the member that
meets most others over all its buckets (a text meets its own copies more often than they meet each other). First
members are checked against their heads alone; the confirmed links join most of a group into one component. In groups
that then still hold several components, the members outside the largest one are compared, in blocks, with each other
and with the largest: first by signatures, which name the members with a partner in another component within the
distance, and then these alone by their texts. Tasks return no pairs but links that join something. Links are confirmed
on the full sets. So every pair within the distance is either checked or already connected.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, join_spread, load, materialize
from .components import connected_components

#: words as the set rule takes them, and A-Z in lower case
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
CHUNKS, CHUNK = 10, 4
POSITIONS = CHUNKS * CHUNK
#: of two sets with similarity 0.8, 8 of 40 minima differ on average; more than 19 differ twice in 100,000 pairs
DISTANCE = 19
BITS = np.uint64(16)
#: members of a group's block, about
BLOCK = 256
_rng = np.random.default_rng(20_240_601)
MULTIPLY = _rng.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
#: for each chunk: the positions that stay when allowed errors are left out
KEPT = [[i * CHUNK + j for j in range(CHUNK) if j not in out] for i in range(CHUNKS) for out in combinations(range(CHUNK), DISTANCE // CHUNKS)]


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles. One shingle if it has fewer words, none without."""
    w = WORD.findall(text.translate(LOWER))
    if not w:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in w], np.uint64)
    if len(h) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), 1)], np.uint64)
    n = len(h) - words + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(words):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(_mix(mixed))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The b-bit minima of a set under POSITIONS hash functions."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 20_000):
        part = hashes[a : a + 20_000, None] * MULTIPLY + ADD
        low = np.minimum(low, (part ^ (part >> np.uint64(32))).min(0))
    return (_mix(low) & np.uint64((1 << int(BITS)) - 1)).astype(np.uint16)


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, n_shingles, set_lo and set_hi (digest of the whole set; null without words), sig, sha (of the text)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                n, lo, hi, sigs, shas = [], [], [], [], []
                for t in texts[a:b]:
                    h = shingle_hashes(t or b"", words)
                    d = xxhash.xxh3_128_intdigest(h.tobytes()) if len(h) else None
                    n.append(len(h))
                    lo.append(None if d is None else (d & (1 << 63) - 1))
                    hi.append(None if d is None else d >> 65)
                    sigs.append(signature(h).tobytes() if len(h) else None)
                    shas.append(hashlib.sha256(t or b"").hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *map(pa.array, (n, lo, hi, sigs, shas), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))],
                    names=["id", "n_shingles", "set_lo", "set_hi", "sig", "sha"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, n_shingles long, set_lo long, set_hi long, sig binary, sha string")


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, rep) for every chunk of the signature and every way to leave out its allowed errors."""

    def run(batches):
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, POSITIONS).astype(np.uint64)
            for i, kept in enumerate(KEPT):
                key = np.full(len(sigs), i + 1, np.uint64)
                for p in kept:
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sigs[:, p])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def near_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of (head, rep, head_sig, sig) within the signature distance."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, POSITIONS) for i in (2, 3))
            near = pa.array((a != b).sum(1) <= DISTANCE)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["u", "v"])

    return pairs.select("head", "rep", "head_sig", "sig").mapInArrow(run, "u long, v long")


def confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough. texts: (rep, t)."""

    def run(batches):
        last, left = None, None
        for batch in batches:
            out = []
            for u, v, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if u != last:
                    last, left = u, shingle_hashes(a, words)
                right = shingle_hashes(b, words)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    left, right = texts.select(F.col("rep").alias("u"), F.col("t").alias("a")), texts.select(F.col("rep").alias("v"), F.col("t").alias("b"))
    # merge joins at any size: a broadcast that only small inputs allow would make plans differ
    return pairs.join(right.hint("merge"), "v").join(left.hint("merge"), "u").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def meeting_blocks(members: DataFrame) -> DataFrame:
    """members: (head, rep, comp, sig). Deals the members of groups with several components to the
    tasks (head, i, j) in which they meet: side says whether as block i or j.

    A group's largest component needs no meetings inside it. Members outside it are dealt to blocks of about BLOCK, and
    each such block i meets all blocks j >= i of these and every block of the largest component (j < 0).
    """
    per = members.groupBy("head", "comp").agg(F.count(F.lit(1)).alias("n"))
    largest = F.max(F.struct("n", F.negative("comp").alias("less")))
    per = per.groupBy("head").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), largest.alias("top")).filter("comps > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    per = per.select("head", "n", F.negative(F.col("top.less")).alias("top"), blocks(F.col("n") - F.col("top.n")).alias("few"), blocks(F.col("top.n")).alias("many"))
    own = join_spread(members, per, "head", "n", ["rep"])
    own = own.withColumn("inside", F.col("comp") == F.col("top"))
    own = own.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("inside"), F.col("many")).otherwise(F.col("few"))).cast("int"))
    meet = lambda i, j, right: F.struct(i.alias("i"), j.alias("j"), right.alias("right"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    as_top = F.transform(every(F.col("few")), lambda i: meet(i, -1 - F.col("block"), F.lit(True)))
    with_few = F.transform(every(F.col("few")), lambda o: meet(F.least("block", o), F.greatest("block", o), F.col("block") > o))
    with_top = F.transform(every(F.col("many")), lambda o: meet(F.col("block"), -1 - o, F.lit(False)))
    places = F.when(F.col("inside"), as_top).otherwise(F.concat(with_few, with_top))
    return own.withColumn("at", F.explode(places)).select("head", "at.i", "at.j", "at.right", "rep", "comp", "sig")


def partners(key, table) -> list[tuple[int, np.ndarray]]:
    """Rows of block i and for each the rows of block j in another component within the signature distance."""
    comp, right = table.column("comp").to_numpy(), table.column("right").to_numpy(zero_copy_only=False)
    sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, POSITIONS)
    inner = key[1].as_py() == key[2].as_py()  # a block with itself
    rows, cols = np.flatnonzero(~right), np.flatnonzero(right | inner)
    out = []
    for r in rows.tolist():
        c = cols[cols > r] if inner else cols
        c = c[comp[c] != comp[r]]
        out.append((r, c[(sigs[c] != sigs[r]).sum(1) <= DISTANCE]))
    return [(r, c) for r, c in out if len(c)]


def across_components(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (u, v) that join different components of a group; enough of them to join what is linked.

    members: (head, rep, comp, sig); texts: (rep, t). Signatures alone are copied to all meetings of blocks; texts only
    for the members that turn out to have a partner there.
    """
    schema = "head long, i int, j int, right boolean, rep long, comp long, sig binary"

    def name(key, table):
        found = partners(key, table)
        needed = np.unique(np.concatenate([np.array([r for r, _ in found], int), *(c for _, c in found)])).astype(int) if found else []
        return table.take(pa.array(needed, pa.int64()))

    dealt = meeting_blocks(members)
    named = materialize(dealt.groupBy("head", "i", "j").applyInArrow(name, schema), "named")

    def meet(key, table):
        found = partners(key, table)
        rep, comp, held = table.column("rep").to_numpy(), table.column("comp").to_numpy(), table.column("t")
        needed = np.unique(np.concatenate([np.array([r for r, _ in found], int), *(c for _, c in found)])).astype(int) if found else np.zeros(0, int)
        sets = {k: shingle_hashes(held[k].as_py(), words) for k in needed.tolist()}
        us, vs, joined = [], [], {}

        def find(x):
            while joined.setdefault(x, x) != x:
                joined[x] = x = joined[joined[x]]
            return x

        right = np.unique(np.concatenate([c for _, c in found])).astype(int) if found else np.zeros(0, int)
        if len(right):  # shingles as numbers from 0; a row's are flagged and counted in all columns at once
            names, flat = np.unique(np.concatenate([sets[k] for k in right.tolist()]), return_inverse=True)
            lengths = np.array([len(sets[k]) for k in right.tolist()])
            starts, place = np.r_[0, np.cumsum(lengths)[:-1]], {k: n for n, k in enumerate(right.tolist())}
            flag = np.zeros(len(names), np.int64)
            for r, candidates in found:
                at = np.searchsorted(names, sets[r])
                at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == sets[r])]
                flag[at] = 1
                both = np.add.reduceat(flag[flat], starts)
                flag[at] = 0
                for c in candidates.tolist():
                    n = int(both[place[c]])
                    if 100 * n >= percent * (len(sets[r]) + len(sets[c]) - n):
                        x, y = find(int(comp[r])), find(int(comp[c]))
                        if x != y:
                            joined[max(x, y)] = min(x, y)
                            us.append(min(rep[r], rep[c]))
                            vs.append(max(rep[r], rep[c]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    with_text = named.join(texts.hint("merge"), "rep").select("head", "i", "j", "right", "rep", "comp", "sig", "t")
    return with_text.groupBy("head", "i", "j").applyInArrow(meet, "u long, v long").distinct()


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_sha: bool = False) -> DataFrame:
    """Joins documents whose word-shingle sets have a Jaccard similarity of at least percent / 100.

    Returns one row per input row: id_col, n_shingles, component_id (smallest id reachable by links, itself
    included), kept (id is the component's); with_sha adds text_sha256. Texts are compared by their words, A-Z in lower
    case. A text with fewer words is one shingle, one without words (or null) has none and links with nothing. Rows
    with a null id link with nothing and are kept. One id on different texts belongs to the component of each; rows
    that repeat a component's smallest id are all kept. Texts are taken whole; a group's members are compared in
    blocks of about BLOCK. An empty table gives no rows; extra columns are ignored.

    Pairs of texts at exactly the threshold are missed about twice in 100,000; see DISTANCE.
    """
    sketches = materialize(sketch(docs, id_col, text_col, words), "sketches")
    known = sketches.filter("id is not null and set_lo is not null")
    first = F.min(F.struct("id", "sha")).alias("first")
    classes = known.groupBy("set_lo", "set_hi").agg(first, F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n"))
    classes = classes.select("set_lo", "set_hi", F.col("first.id").alias("low"), F.col("first.sha").alias("sha"), "sig", "n")
    # written out, so that a class keeps its number
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    index = materialize(index_keys(classes), "index")
    # tables, so that the joins with large buckets see plain shuffles, which Spark can split
    sizes = materialize(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    shared = materialize(join_spread(index, sizes, "key", "n", ["rep"]), "shared")
    # the head of a bucket is the member that meets most others over all its buckets: the text that copies stem from
    weights = shared.groupBy("rep").agg(F.sum("n").alias("weight"))
    weighed = shared.join(weights, "rep")
    foremost = F.col("weight") * (1 << 20) - F.pmod(F.xxhash64("rep"), F.lit(1 << 20))
    heads = materialize(weighed.groupBy("key").agg(F.max_by("rep", foremost).alias("head"), F.max("n").alias("n")), "heads")
    # members of one bucket have one head, so the groups of the heads hold all pairs that share a key
    groups = materialize(join_spread(shared.select("key", "rep"), heads, "key", "n", ["rep"]).select("head", "rep").distinct(), "groups")
    # one text for each class that shares a key
    used = classes.join(groups.select("rep").distinct(), "rep").select(F.col("low").alias("id"), "sha", "rep")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.sha2(text, 256).alias("sha"))
    texts = materialize(rows.join(used.hint("merge"), ["id", "sha"]).groupBy("id", "sha", "rep").agg(F.first("t").alias("t")).select("rep", "t"), "texts")

    sigs = classes.select("rep", "sig")
    sized = groups.groupBy("head").agg(F.count(F.lit(1)).alias("n")).join(sigs.select(F.col("rep").alias("head"), F.col("sig").alias("head_sig")), "head")
    star = join_spread(groups.filter("rep <> head").join(sigs, "rep"), materialize(sized, "sized"), "head", "n", ["rep"])
    star = materialize(near_pairs(star), "star")
    links = materialize(confirm(star, texts, words, percent), "links")
    joined = connected_components(links).withColumnRenamed("id", "rep").withColumnRenamed("component_id", "comp")

    members = groups.join(joined, "rep", "left").join(sigs, "rep").select("head", "rep", F.coalesce("comp", "rep").alias("comp"), "sig")
    more = materialize(across_components(materialize(members, "members"), texts, words, percent), "more-links")
    components = connected_components(links.unionByName(more)).withColumnRenamed("id", "rep").join(classes.select("rep", "set_lo", "set_hi", "low", "n"), "rep")
    lowest = components.groupBy("component_id").agg(F.min("low").alias("_comp"))
    of_class = components.join(lowest, "component_id").select("rep", "_comp")
    of_class = classes.select("set_lo", "set_hi", "low", "rep", "n").join(of_class, "rep", "left")
    of_class = materialize(of_class.select("set_lo", "set_hi", F.coalesce("_comp", "low").alias("_comp"), "n"), "components")
    sketches = sketches.select("id", "n_shingles", "sha", "set_lo", "set_hi")
    rows = join_spread(sketches.filter("set_lo is not null"), of_class, ["set_lo", "set_hi"], "n", ["id", "sha"], "left")
    rows = rows.select("id", "n_shingles", "sha", "_comp").unionByName(sketches.filter("set_lo is null").select("id", "n_shingles", "sha", F.lit(None).cast("long").alias("_comp")))
    comp = F.when(F.col("id").isNotNull(), F.coalesce("_comp", "id"))
    out = rows.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"), F.col("sha").alias("text_sha256"))
    return out if with_sha else out.drop("text_sha256")


def op9(spark, sf_dir):
    return near_dedup(load(spark, sf_dir, "documents"), words=4, percent=80)
