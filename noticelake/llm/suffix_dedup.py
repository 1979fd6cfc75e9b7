"""Removal of long repeated byte strings by sorting suffixes, deep-shallow.

Not every suffix is sorted. Each string of LENGTH bytes contains the smallest-hashed gram of GRAM bytes among its
own grams, and its copies contain the same one at the same place, so only suffixes at such anchors are needed
(about one in LENGTH / 2 bytes), together with the bytes in front of them. Anchors whose gram is unique go first.
Anchors with the same whole context (all windows that hold the gram) cover each other without a look at the text.
What is left, contexts that share a gram but differ somewhere, is the edge of repeats: these are dealt out by
gram and sorted by their suffixes, word by word down to a shallow depth (multikey quicksort, 8 bytes a step), and
suffixes that still tie there by blind tries. Neighbours in that order give the longest common extensions to the
right; refining the order by one more byte to the left at a time keeps them for every window position.

The contexts of a gram are dealt to as many parts of about PART as they need, and each part is sorted. Where a gram has
several parts, they are merged by the windows that each still holds as one of a kind: those that another part holds
too repeat as well.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, load, materialize

LENGTH, GRAM = 200, 48
#: bytes compared before blind tries take over
SHALLOW = GRAM + 32
#: different contexts of one gram that are sorted together, about
PART = 20_000
#: bytes of text that are anchored, and contexts that are sorted, at once
PIECE, CONTEXTS = 4 << 20, 30_000
NO_ID = -(1 << 63)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM (48) bytes from each place on."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    h8 = _mix(words * np.uint64(0x9E3779B97F4A7C15))
    join = lambda a, b: _mix(a * np.uint64(0xC2B2AE3D27D4EB4F) + b)
    h16 = join(h8[:-8], h8[8:])
    h32 = join(h16[:-16], h16[16:])
    return join(h32[:-16], h16[32:])


def sliding_smallest(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places that are the first smallest of some window of as many places. Places with hash NONE never are."""
    n = len(hashes)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    keys[hashes == NONE] = NONE
    rows = -(-n // window) + 1
    padded = np.full(rows * window, NONE)
    padded[:n] = keys
    grid = padded.reshape(rows, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    low = low[low != NONE]
    return np.unique(low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """document number, place, context start and end (in the document) and gram hash of the anchors of documents
    data[starts[i]:ends[i]], each of LENGTH bytes at least."""
    h = np.full(len(data), NONE)
    h[: len(data) - GRAM + 1] = gram_hashes(data)
    for e in ends:
        h[max(0, e - GRAM + 1) : e] = NONE
    at = sliding_smallest(h, LENGTH - GRAM + 1)
    doc = np.searchsorted(starts, at, side="right") - 1
    place = at - starts[doc]
    low = np.maximum(place - (LENGTH - GRAM), 0)
    high = np.minimum(place + LENGTH, ends[doc] - starts[doc])
    return doc, place, low, high, h[at]


def anchors(texts: DataFrame) -> DataFrame:
    """texts: (id, u, t). Returns key (gram), ctx (digest of the context), id, u, pos, lo, hi."""

    def flush(held):
        data = np.frombuffer(b"".join(t for _, _, t in held), np.uint8)
        ends = np.cumsum([len(t) for _, _, t in held])
        starts = ends - [len(t) for _, _, t in held]
        doc, place, low, high, key = anchors_of(data, starts, ends)
        raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
        a, b = (starts[doc] + low).tolist(), (starts[doc] + high).tolist()
        ctx = np.array([digest(raw[i:j], s) for i, j, s in zip(a, b, (place - low).tolist(), strict=True)], np.uint64)
        ids, us = np.array([i for i, _, _ in held], np.int64), np.array([u for _, u, _ in held], np.int64)
        arrays = [key.view(np.int64), ctx.view(np.int64), ids[doc], us[doc], place.astype(np.int32), low.astype(np.int32), high.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["key", "ctx", "id", "u", "pos", "lo", "hi"])

    def run(batches):
        for batch in batches:
            held, size = [], 0
            for i, u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                t = t.as_buffer().to_pybytes()
                if len(t) < LENGTH:
                    continue
                held.append((i, u, t))
                size += len(t)
                if size >= PIECE:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)

    return texts.select("id", "u", "t").mapInArrow(run, "key long, ctx long, id long, u long, pos int, lo int, hi int")


class BlindTrie:
    """Orders byte strings: inner nodes hold a depth and children by the byte there, leaves the strings' numbers.

    A string walks down by its bytes at the nodes' depths alone, is compared once with a leaf that it reaches, and
    branches off where the two differ.
    """

    def __init__(self) -> None:
        self.root = None

    def insert(self, s: bytes, number: int) -> None:
        if self.root is None:
            self.root = (s, [number])
            return
        node, path = self.root, []
        while isinstance(node, list):
            path.append(node)
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = node[0]
        n = min(len(s), len(other))
        x = int.from_bytes(s[:n]) ^ int.from_bytes(other[:n])
        same = n - (x.bit_length() + 7) // 8
        if same == len(s) == len(other):
            node[1].append(number)
            return
        mine, theirs = (s[same] if same < len(s) else -1), (other[same] if same < len(other) else -1)
        above = None
        for inner in path:
            if inner[0] >= same:
                if inner[0] == same:
                    inner[1][mine] = (s, [number])
                    return
                break
            above = inner
        below = self.root if above is None else above[1][s[above[0]] if above[0] < len(s) else -1]
        fork = [same, {theirs: below, mine: (s, [number])}]
        if above is None:
            self.root = fork
        else:
            above[1][s[above[0]] if above[0] < len(s) else -1] = fork

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += node[1]
        return out


def multikey_quicksort(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of words within their (ascending) groups, and numbers that rows share which tie in all words.

    Every round splits all open groups at once, each by its middle row's word: smaller, equal and larger words become
    groups of their own, and the equal ones go on to the next word.
    """
    n, depths = words.shape
    order, tied, depth = np.arange(n), group.astype(np.int64), np.zeros(n, np.int64)
    while n:
        starts = np.flatnonzero(np.r_[True, tied[1:] != tied[:-1]])
        sizes = np.diff(np.r_[starts, n])
        tied = np.repeat(np.arange(len(starts)), sizes)
        open_groups = (sizes > 1) & (depth[starts] < depths)
        if not open_groups.any():
            break
        at = np.flatnonzero(open_groups[tied])
        middle = (starts + sizes // 2)[tied[at]]
        word, pivot = words[order[at], depth[at]], words[order[middle], depth[middle]]
        side = (word >= pivot).astype(np.int64) + (word > pivot)
        new = np.argsort(tied[at] * 3 + side, kind="stable")
        order[at], depth[at] = order[at[new]], (depth[at] + (side == 1))[new]
        label = tied * 3
        label[at] += side[new]
        tied = label
    return order, tied


def deep_shallow_order(group: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Order of the suffixes right[i, :lengths[i]] within their (ascending) groups, whose first GRAM bytes agree."""
    words = np.ascontiguousarray(right[:, GRAM:SHALLOW]).view(">u8").astype(np.uint64)
    order, tied = multikey_quicksort(group, words)
    starts = np.flatnonzero(np.r_[True, np.diff(tied) != 0])
    ends = np.r_[starts[1:], len(order)]
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        trie = BlindTrie()
        for i in order[a:b].tolist():
            trie.insert(right[i, SHALLOW : lengths[i]].tobytes(), i)
        order[a:b] = trie.order()
    return order


def common_lengths(a: np.ndarray, b: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes a[i] and b[i] share."""
    out = np.empty(len(a), np.int64)
    for k in range(0, len(a), 50_000):
        x, y = a[k : k + 50_000], b[k : k + 50_000]
        differ = np.ones((len(x), LENGTH + 1), bool)
        differ[:, :LENGTH] = right[x] != right[y]
        out[k : k + 50_000] = differ.argmax(1)
    return np.minimum(out, np.minimum(lengths[a], lengths[b]))


def repeated_windows(group: np.ndarray, left: np.ndarray, left_lengths: np.ndarray, right: np.ndarray, right_lengths: np.ndarray) -> np.ndarray:
    """For each context and o: whether the LENGTH bytes from o bytes in front of the anchor on are also those of
    another context of its group. left[i, o] is the byte o + 1 places in front of the anchor."""
    reach = LENGTH - GRAM
    found = np.zeros((len(group), reach + 1), bool)
    if not len(group):
        return found
    rows = deep_shallow_order(group, right, right_lengths)
    kind = group[rows].astype(np.int64)  # rows of one kind agree in the o bytes to the left
    shared = np.zeros(len(rows), np.int64)  # with the row before, 0 at the start of a kind
    same = np.flatnonzero(kind[1:] == kind[:-1]) + 1
    shared[same] = common_lengths(rows[same - 1], rows[same], right, right_lengths)
    for o in range(reach + 1):
        best = np.maximum(shared, np.r_[shared[1:], 0])
        found[rows[best >= LENGTH - o], o] = True
        # one more byte to the left: rows that have none leave, kinds split by it
        if o == reach:
            break
        go = left_lengths[rows] > o
        byte = left[rows, o].astype(np.int64)
        split = np.flatnonzero((kind[1:] == kind[:-1]) & ((byte[1:] != byte[:-1]) | ~go[1:] | ~go[:-1]))
        if len(split):
            touched = np.isin(kind, kind[split])
            sub = np.flatnonzero(touched & go)
            new = sub[np.argsort(kind[sub] * 256 + byte[sub], kind="stable")]
            label = kind[new] * 256 + byte[new]
            stay = np.flatnonzero(~touched & go)
            n_rows = np.r_[rows[stay], rows[new]]
            n_kind = np.r_[kind[stay] * 256 + byte[stay], label]
            n_shared = np.r_[shared[stay], np.zeros(len(new), np.int64)]
            again = np.flatnonzero(label[1:] == label[:-1]) + 1
            n_shared[len(stay) + again] = common_lengths(rows[new[again - 1]], rows[new[again]], right, right_lengths)
            rows, shared = n_rows, n_shared
            kind = np.unique(n_kind, return_inverse=True)[1] if len(n_kind) else n_kind
        elif not go.all():
            rows, kind, shared = rows[go], kind[go], shared[go]
        # a kind of one row is done
        first = np.r_[True, kind[1:] != kind[:-1]] if len(kind) else np.zeros(0, bool)
        alone = first & np.r_[first[1:], True] if len(kind) else first
        if alone.any():
            rows, kind, shared = rows[~alone], kind[~alone], shared[~alone]
        if not len(rows):
            break
    return found


def spans_of(found: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and end of what runs of repeated windows cover."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, near = np.nonzero(edge == 1)
    _, far = np.nonzero(edge == -1)
    return row, pos[row] - (far - 1), pos[row] - near + LENGTH


SORTED = "id long, u long, lo int, hi int, key long, d0 long, d1 long"


def sort_contexts(contexts: DataFrame) -> DataFrame:
    """contexts: (key, part, parts, n, id, u, pos, lo, c), all of a part in one partition and in order.

    Spans (id, u, lo, hi) of contexts with n = 1; d0 and d1 are null there. Of keys with several parts also the
    different windows of each part, as digests d0, d1; hi is null where a window is not to be marked.
    """

    def solve(table: pa.Table):
        key, part, parts, n, ids, us, pos, low = (table.column(c).to_numpy() for c in ("key", "part", "parts", "n", "id", "u", "pos", "lo"))
        cs = table.column("c").to_pylist()
        left_lengths, reach = (pos - low).astype(np.int64), LENGTH - GRAM
        right_lengths = np.array([len(c) for c in cs]) - left_lengths
        left = np.frombuffer(b"".join(c[:k][::-1].ljust(reach, b"\0") for c, k in zip(cs, left_lengths.tolist(), strict=True)), np.uint8).reshape(-1, reach)
        right = np.frombuffer(b"".join(c[k:].ljust(LENGTH, b"\0") for c, k in zip(cs, left_lengths.tolist(), strict=True)), np.uint8).reshape(-1, LENGTH)
        group = np.cumsum(np.r_[0, (np.diff(key) != 0) | (np.diff(part) != 0)])
        found = repeated_windows(group, left, left_lengths, right, right_lengths)
        row, a, b = spans_of(found & (n == 1)[:, None], pos.astype(np.int64))
        nothing = pa.nulls(len(row), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(us[row]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(key[row]), nothing, nothing], names=names)
        several = np.flatnonzero(parts > 1)
        for k in range(0, len(several), 2000):
            yield windows(several[k : k + 2000], found, group, key, n, ids, us, pos, low, cs)

    def windows(rows, found, group, key, n, ids, us, pos, low, cs):
        digest, seen, out = xxhash.xxh3_128_intdigest, set(), []
        for i in rows.tolist():
            c, before, once = cs[i], int(pos[i] - low[i]), n[i] == 1
            for s in range(max(0, before - LENGTH + GRAM), min(before, len(c) - LENGTH) + 1):
                x = digest(c[s : s + LENGTH], before - s)
                again = found[i, before - s]
                if again and (group[i], x) in seen:
                    continue
                seen.add((group[i], x))
                at = int(low[i]) + s
                out.append((ids[i], us[i], at, at + LENGTH if once and not again else None, key[i], x & (1 << 63) - 1, x >> 65))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    def run(batches):
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < CONTEXTS:
                continue
            table = pa.concat_tables(held)
            key, part = table.column("key").to_numpy(), table.column("part").to_numpy()
            cut = int(np.flatnonzero((key == key[-1]) & (part == part[-1]))[0])  # the last part may go on
            if cut:
                yield from solve(table.slice(0, cut))
            held = [table.slice(cut)]
        if held:
            yield from solve(pa.concat_tables(held))

    names = [x.split()[0] for x in SORTED.split(", ")]
    return contexts.select("key", "part", "parts", "n", "id", "u", "pos", "lo", "c").mapInArrow(run, SORTED)


def repeated_spans(texts: DataFrame, per_part: int = PART) -> DataFrame:
    """texts: (id, u, t). Spans (id, u, lo, hi) whose union is what repeats; they may overlap."""
    every = anchors(texts)
    # written out, so that both sides of the joins are plain shuffles, whose large partitions Spark can split
    shared = materialize(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared-grams")
    kept = materialize(join_spread(every, shared, "key", "n", ["id", "pos"]).drop("n"), "anchors")
    firsts = [F.first(c).alias(c) for c in ("id", "u", "pos", "lo", "hi")]
    contexts = materialize(kept.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), *firsts), "contexts")
    copies = contexts.filter("n > 1").select("key", "ctx", "n")
    whole = join_spread(kept, copies, ["key", "ctx"], "n", ["id", "pos"]).filter(F.col("hi") - F.col("lo") >= LENGTH).select("id", "u", "lo", "hi")
    edges = materialize(contexts.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "edge-grams")
    edge = join_spread(contexts, edges, "key", "kinds", ["ctx"]).withColumn("parts", F.ceil(F.col("kinds") / per_part).cast("int"))
    edge = edge.select("key", F.pmod("ctx", F.col("parts")).cast("int").alias("part"), "parts", "n", "id", "u", "pos", "lo", "hi")
    with_text = edge.join(texts, ["id", "u"]).select("key", "part", "parts", "n", "id", "u", "pos", "lo", F.expr("substring(t, lo + 1, hi - lo)").alias("c"))
    in_order = sort_contexts(with_text.repartition("key", "part").sortWithinPartitions("key", "part"))
    in_order = materialize(in_order, "sorted")
    held = in_order.filter("d0 is not null")
    often = held.groupBy("key", "d0", "d1").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    across = held.filter("hi is not null").join(often, ["key", "d0", "d1"], "left_semi").select("id", "u", "lo", "hi")
    return whole.unionByName(in_order.filter("d0 is null").select("id", "u", "lo", "hi")).unionByName(across)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False, per_part: int = PART) -> DataFrame:
    """Removes every byte that a string of LENGTH bytes covers which also starts anywhere else, in any row.

    Returns one row per input row: id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the
    bytes left, in lowercase hex); with_bytes adds spans (array of first byte and end) and kept_bytes (binary).
    Texts are UTF-8 bytes, null counts as empty; matches never cross rows. Rows that repeat a text repeat all its
    strings, so such texts of LENGTH bytes or more go whole. Null ids are kept as they are; one id may stand on several
    texts. Very long texts are taken whole and held by one task at a time. An empty table gives no rows; extra columns
    are ignored.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), t.alias("t")).withColumn("u", F.xxhash64("t"))
    spans = repeated_spans(texts, per_part).groupBy("id", "u").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def cut(batches):
        for batch in batches:
            out = []
            for i, t, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                merged: list[list[int]] = []
                if spans.is_valid:
                    lo, hi = (spans.values.field(k).to_numpy() for k in (0, 1))
                    for a, b in sorted(set(zip(lo.tolist(), hi.tolist(), strict=True))):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], b)
                        else:
                            merged.append([a, b])
                left, at = [], 0
                for a, b in merged:
                    left.append(t[at:a])
                    at = b
                left = b"".join([*left, t[at:]])
                row = (i if i != NO_ID else None, len(t), len(t) - len(left), len(merged), hashlib.sha256(left).hexdigest())
                out.append((*row, merged, left) if with_bytes else row)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    names, kinds = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [*[pa.int64()] * 4, pa.string()]
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_bytes:
        names, kinds = [*names, "spans", "kept_bytes"], [*kinds, pa.list_(pa.list_(pa.int32())), pa.binary()]
        schema += ", spans array<array<int>>, kept_bytes binary"
    return texts.join(spans, ["id", "u"], "left").select("id", "t", "spans").mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def op1(spark, sf_dir):
    return suffix_dedup(load(spark, sf_dir, "documents"))
